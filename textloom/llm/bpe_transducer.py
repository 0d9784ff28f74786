"""Operator 10: byte-level BPE as a lazily determinised finite-state transducer.

Method: two neighbouring tokens are *compatible* when their joined bytes encode
to just these two; a token sequence is the encoding of its bytes exactly when
all neighbours are compatible.  The vocabulary's trie with that condition is a
nondeterministic transducer over bytes, whose configurations are (last token,
trie node).  Its subsets are made into states when a text first needs them, and
kept.  A state names the last token of the encoding of what was read; when a
state holds one configuration only, all tokens so far are certain and are
emitted, so the lookahead is bounded by the longest token.

Each match of the pattern is encoded by itself; matches that a worker has met
are remembered.  Decoding feeds the tokens' bytes to an incremental UTF-8 state
machine, so that text can be given out while tokens come in.

Cases: a null text counts as empty (no tokens, digests of nothing); every row
gives a row, whatever its doc_id; an empty table gives none; other columns are
not read.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import slices, table
from textloom.llm.word_tokens import public_path

RANKS = "byte_bpe_50k.tiktoken"
#: States and remembered matches of a worker; beyond, states are made anew and matches encoded each time.
MAX_STATES, MAX_MATCHES, MAX_MATCH_CHARS = 200_000, 250_000, 48
ROOT = 0


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BpeTransducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self._compile_merges()
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            if len(token) == 1 or rank in self.parts:
                self._add(token, rank)
        self.compatible_memo: dict[tuple[int, int], bool] = {}
        #: Matches that a worker has met: ids, and the ids as text.
        self.memory: dict[str, tuple[tuple[int, ...], str]] = {}
        self._reset()

    def _compile_merges(self) -> None:
        """Each token's last merge; tokens that no merges lead to are left out."""
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = [self.ranks[token[i : i + 1]] for i in range(len(token))]
                while len(parts) > 2:
                    found = [(m, i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if (m := self.merged.get(p)) is not None]
                    if not found:
                        break
                    m, i = min(found)
                    parts[i : i + 2] = [m]
                if len(parts) == 2:
                    self.parts[rank] = (parts[0], parts[1])
                    self.merged[parts[0], parts[1]] = rank

    def _add(self, token: bytes, rank: int) -> None:
        at = ROOT
        for c in token:
            nxt = self.children[at].get(c)
            if nxt is None:
                nxt = self.children[at][c] = len(self.children)
                self.children.append({})
                self.token_at.append(-1)
            at = nxt
        self.token_at[at] = rank

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge joins the two before both are complete.

        The merges inside either token are undone from the latest on; at every
        step the two tokens at the border must not merge earlier than that.
        """
        got = self.compatible_memo.get((a, b))
        if got is None:
            got = self.compatible_memo[a, b] = self._compatible(a, b)
            if len(self.compatible_memo) > 4 * MAX_STATES:
                self.compatible_memo.clear()
        return got

    def _compatible(self, a: int, b: int) -> bool:
        left, right = a, b
        before: float = float("inf")  # merges from this rank on come too late at this border
        while True:
            m = self.merged.get((left, right))
            if m is not None and m < before:
                return False
            lp, rp = self.parts.get(left), self.parts.get(right)
            if lp is None and rp is None:
                return True
            # of the two tokens at the border, the one that was made last; a tie is made from left to right
            if rp is None or (lp is not None and left > right):
                before, left = left, lp[1]
            else:
                before, right = right + 1, rp[0]

    def _reset(self) -> None:
        start = ((-1, ROOT),)
        self.states: list[tuple[tuple[int, int], ...]] = [start]
        self.number = {start: 0}
        self.steps: list[dict[int, tuple[int, int, bool]]] = [{}]

    def _step(self, state: int, c: int) -> tuple[int, int, bool]:
        """Next state, the last token of the encoding up to here, and whether it is certain."""
        alive, last = [], -1
        for prev, node in self.states[state]:
            nxt = self.children[node].get(c)
            if nxt is None:
                continue
            if self.children[nxt]:
                alive.append((prev, nxt))
            token = self.token_at[nxt]
            if token >= 0 and last < 0 and (prev < 0 or self.compatible(prev, token)):
                last = token
        alive.append((last, ROOT))
        key = tuple(alive)
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        got = self.steps[state][c] = (n, last, len(alive) == 1)
        return got

    def encode(self, match: bytes) -> tuple[int, ...]:
        """Token ids of one match of the pattern."""
        whole = self.ranks.get(match)
        if whole is not None:
            return (whole,)
        if len(self.states) > MAX_STATES:
            self._reset()
        out: list[int] = []
        trail: list[int] = []
        state, steps = 0, self.steps
        for c in match:
            got = steps[state].get(c)
            state, last, certain = self._step(state, c) if got is None else got
            trail.append(last)
            if certain:
                out += self._trace(trail)
                trail = []
        return tuple(out + self._trace(trail))

    def _trace(self, trail: list[int]) -> list[int]:
        """Tokens of a stretch from the last token at each of its bytes."""
        at, out = len(trail), []
        while at > 0:
            out.append(trail[at - 1])
            at -= len(self.bytes_of[out[-1]])
        return out[::-1]


def decode_stream(tokens: Iterable[int], bytes_of: dict[int, bytes], chunk: int = 4096) -> Iterator[tuple[bytes, str]]:
    """Bytes and the text that they complete, chunk by chunk; bytes that are no UTF-8 become U+FFFD."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    tokens = iter(tokens)
    while some := list(islice(tokens, chunk)):
        part = b"".join(map(bytes_of.__getitem__, some))
        yield part, machine.decode(part)
    if rest := machine.decode(b"", final=True):
        yield b"", rest


_loaded: dict[str, BpeTransducer] = {}


def transducer(path: str) -> BpeTransducer:
    if path not in _loaded:
        _loaded[path] = BpeTransducer(read_ranks(path))
    return _loaded[path]


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, fst = regex.compile(pattern).findall, transducer(path)
        memory = fst.memory
        for b in slices(batches):
            rows, met = [], dict.fromkeys(())
            for text in b.column("text").to_pylist():
                matches = find(text or "")
                new = [m for m in set(matches) if m not in memory and m not in met]
                for m in new:
                    ids = fst.encode(m.encode())
                    kept = memory if len(memory) < MAX_MATCHES and len(m) <= MAX_MATCH_CHARS else met
                    kept[m] = ids, " ".join(map(str, ids))
                if not met:
                    pairs = list(map(memory.__getitem__, matches))
                else:
                    pairs = [memory.get(m) or met[m] for m in matches]
                    if len(met) > MAX_MATCHES // 4:
                        met.clear()
                ids = list(chain.from_iterable(p[0] for p in pairs))
                whole = hashlib.sha256()
                chars = 0
                for part, piece in decode_stream(ids, fst.bytes_of):
                    whole.update(part)
                    chars += len(piece)
                rows.append((len(ids), hashlib.sha256(" ".join([p[1] for p in pairs]).encode()).hexdigest(), whole.hexdigest(), chars))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_chars"])

    return run


def _ids(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, fst = regex.compile(pattern).findall, transducer(path)
        for b in slices(batches):
            ids = [list(chain.from_iterable(fst.encode(m.encode()) for m in find(t or ""))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` of ``docs(doc_id, text)``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_ids(ranks_path, pattern), "doc_id long, ids array<int>")


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(path)
        for b in batches:
            text = ["".join(t for _, t in decode_stream(ids or (), fst.bytes_of)) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return run


def decode(ids: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, text`` of ``ids(doc_id, ids)``."""
    return ids.select("doc_id", "ids").mapInArrow(_texts(ranks_path), "doc_id long, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to, in one pass."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_encode(ranks_path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long")


def op10_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_path(RANKS), public_tokenizers.PATTERN)
