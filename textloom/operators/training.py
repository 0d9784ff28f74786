"""Training sets: pairs, labels, augmentation, split, template; and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import fixed
from textloom.functions.names import fresh
from textloom.functions.text import java, strip


def training_pairs(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, history, response``: each assistant turn right after a user's, with all that came before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    past = F.collect_list(F.struct("role", F.coalesce(F.col("text"), F.lit("")).alias("content"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = messages.withColumns({"before": F.lag("role").over(w), "history": past})
    return rows.where("role = 'assistant' and before = 'user'").select("conv_id", "turn", "history", F.coalesce(F.col("text"), F.lit("")).alias("response"))


def compressed_prompt(text: Column) -> Column:
    """Lines stripped, blank ones dropped, those that look like JSON cut at 200 characters."""
    lines = F.filter(F.transform(F.split(strip(text), "\n"), strip), lambda s: s != "")
    return F.array_join(F.transform(lines, lambda s: F.when(s.rlike(r"^[\[{]"), F.concat(F.substring(s, 1, 200), F.lit("..."))).otherwise(s)), "\n")


def draw(key: Column, seed: int) -> Column:
    """A number from 0 to 2^32 - 1 by a digest of the key: the same in every run and every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), key)), 1, 8), 16, 10).cast("long")


def sampled(key: Column, share: float, seed: int) -> Column:
    return draw(key, seed) % 1_000_000 < int(share * 1_000_000)


def _last_replaced(content: Column) -> Column:
    n = F.size("history")
    last = F.try_element_at("history", F.lit(-1))
    return F.concat(F.slice("history", F.lit(1), n - 1), F.array(F.struct(last["role"].alias("role"), content.alias("content"))))


def augmented(pairs: DataFrame, compression: float = 0.2, references: float = 0.15, seed: int = 42) -> DataFrame:
    """``pairs`` with ``kind`` plain, and hash-sampled copies of kind compressed (where the prompt changes) and reference."""
    key = F.concat_ws("/", F.col("conv_id"), F.col("turn"))
    prompt = F.try_element_at("history", F.lit(-1))["content"]
    short = compressed_prompt(prompt)
    one = pairs.withColumn("kind", F.lit("plain"))
    two = one.where(sampled(key, compression, seed) & (short != prompt)).withColumns({"history": _last_replaced(short), "kind": F.lit("compressed")})
    told = F.concat(F.lit(fixed.REFERENCE_EXAMPLE[0]), prompt, F.lit(fixed.REFERENCE_EXAMPLE[1]))
    # reference examples are drawn from plain and compressed pairs alike
    base = one.unionByName(two)
    three = base.where(sampled(F.concat(key, F.lit("/"), F.col("kind")), references, seed + 1)).withColumns({"history": _last_replaced(told), "kind": F.lit("reference")})
    return base.unionByName(three)


def split(rows: DataFrame, key: Column, share: float = 0.1, seed: int = 42, least: int = 10) -> DataFrame:
    """``rows`` with ``part``: the ``max(1, int(n * share))`` rows of the lowest digests are eval, the others train.

    Fewer than ``least`` rows give none.  Rows are not sorted: counts of 4,096
    ranges of the digest find the one in which the last eval row lies, and only
    that range's rows are ordered.  Rows of the last one's key stay together.
    """
    name = fresh("__draw", rows)
    drawn = rows.withColumn(name, F.struct(draw(key, seed).alias("h"), key.alias("k")))
    counts = {r["b"]: r["count"] for r in drawn.groupBy(F.shiftright(f"{name}.h", 20).alias("b")).count().collect()}  # at most 4,096 rows
    n = sum(counts.values())
    if n < max(1, least):
        return rows.withColumn("part", F.lit("train")).limit(0)
    left = max(1, int(n * share))
    for b in sorted(counts):
        if left <= counts[b]:
            break
        left -= counts[b]
    some = drawn.where(F.shiftright(f"{name}.h", 20) == b).select(name).orderBy(name).limit(left)
    last = some.agg(F.max(name).alias("m")).first()["m"]
    low = (F.col(f"{name}.h") < last["h"]) | (F.col(f"{name}.h") == last["h"]) & (F.col(f"{name}.k") <= last["k"])
    return drawn.withColumn("part", F.when(low, "eval").otherwise("train")).drop(name)


def synth_sentences(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """``id, text``: ``n`` verbose sentences, each by digests of its number."""

    def one_of(words: tuple[str, ...], part: int) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), (draw(F.col("id").cast("string"), seed + part) % len(words) + 1).cast("int"))

    def chance(share: float, part: int) -> Column:
        return sampled(F.col("id").cast("string"), share, seed + part)

    filler = one_of(fixed.SYNTH_FILLERS, 1)
    head = F.when(chance(0.8, 2), F.concat(F.upper(F.substring(filler, 1, 1)), F.substring(filler, 2, 1000), F.lit(",")))
    more = F.when(chance(0.5, 5), F.concat_ws(" ", F.lit("and"), one_of(fixed.SYNTH_VERBOSE, 6), one_of(fixed.SYNTH_CONTENT, 7)))
    return spark.range(n).select("id", F.concat(F.concat_ws(" ", head, one_of(fixed.SYNTH_VERBOSE, 3), one_of(fixed.SYNTH_CONTENT, 4), more), F.lit(".")).alias("text"))


def token_accuracy(rows: DataFrame) -> DataFrame:
    """``token_accuracy`` of ``rows(predicted, labels)``, arrays by row; labels of -100 don't count; 0 without any."""
    both = F.filter(F.arrays_zip("predicted", "labels"), lambda x: x["labels"] != -100)
    right = F.size(F.filter(both, lambda x: x["predicted"] == x["labels"]))
    sums = rows.select(F.size(both).alias("n"), right.alias("right")).agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    return sums.select(F.when(F.col("n") > 0, F.col("right") / F.col("n")).otherwise(0.0).alias("token_accuracy"))


def label_words(pairs: DataFrame) -> DataFrame:
    """``doc_id, words, labels`` of ``pairs(doc_id, original, compressed)``: 1 for a word that survives, by number of occurrence."""
    word = lambda c: F.regexp_extract_all(F.col(c), F.lit(java(r"\w+|[^\w\s]")), F.lit(0))
    left = pairs.select("doc_id", F.posexplode(word("original")).alias("p", "word")).withColumn("key", F.lower("word"))
    left = left.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("p")))
    right = pairs.select("doc_id", F.explode(word("compressed")).alias("word")).groupBy("doc_id", F.lower("word").alias("key")).agg(F.count("*").alias("kept"))
    both = left.join(right, ["doc_id", "key"], "left").withColumn("label", (F.col("nth") <= F.coalesce("kept", F.lit(0))).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("p", "word", "label")))
    return both.groupBy("doc_id").agg(ordered.alias("x")).select("doc_id", F.col("x.word").alias("words"), F.col("x.label").alias("labels"))


def dropped_share(labelled: DataFrame) -> DataFrame:
    """``labelled`` rows of which some word was dropped, with the share of words dropped."""
    kept = F.aggregate("labels", F.lit(0), lambda s, v: s + v)
    return labelled.withColumn("dropped", 1 - kept / F.size("labels")).where((F.size("labels") > 0) & (F.col("dropped") > 0))


def formatted(pairs: DataFrame) -> DataFrame:
    """``conv_id, turn, text``: a tagged line for each message of the three roles, and the response."""
    tag = lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"])
    known = F.filter("history", lambda m: m["role"].isin("system", "user", "assistant"))
    return pairs.select("conv_id", "turn", F.concat(F.array_join(F.transform(known, tag), "\n"), F.lit("\n<|assistant|>\n"), F.col("response")).alias("text"))


def fact_retention(cases: DataFrame) -> DataFrame:
    """``case_id, n_facts, n_kept`` of ``cases(case_id, compressed, facts)``; white space counts as one space."""
    plain = lambda x: F.regexp_replace(strip(x), java(r"\s+"), " ")
    text = plain(F.col("compressed"))
    kept = F.size(F.filter("facts", lambda f: text.contains(plain(f))))
    return cases.select("case_id", F.size("facts").cast("long").alias("n_facts"), kept.cast("long").alias("n_kept"))


def model_fit(models: DataFrame, budget: Column, k: int = 20) -> DataFrame:
    """The first ``k`` of ``models(name, size_mb)`` with ``fit``: what fits well first, large before small, then by name."""
    need = F.col("size_mb")
    fit = F.when(budget.isNull() | need.isNull() | (need == 0), "unknown").when(need <= budget * 0.7, "comfortable").when(need <= budget, "tight").otherwise("too_large")
    order = F.array_position(F.array(*map(F.lit, ("comfortable", "tight", "unknown", "too_large"))), F.col("fit"))
    return models.withColumn("fit", fit).orderBy(order, F.desc(F.coalesce(need, F.lit(0))), "name").limit(k)
