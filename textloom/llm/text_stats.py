"""Counts of whole texts, a batch at a time: Arrow splits words, numpy counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.frombuffer(b" \t\n\v\f\r", np.uint8)
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
PUNCTUATION = np.frombuffer(b"!\"'()+,-./:;=?@[\\]^_`{}~", np.uint8)
WINDOW = 5

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_punct", "n_distinct")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads any difference over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(codes: np.ndarray, doc: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """By document, the words inside windows that occur twice or more in it (equal 64-bit keys)."""
    n = len(codes) - window + 1
    out = np.zeros(n_docs, np.int64)
    if n < 2:
        return out
    whole = np.flatnonzero(doc[:n] == doc[window - 1 :])
    key = mix(doc[whole].astype(np.uint64) + np.uint64(1))
    for k in range(window):
        key = mix(key + codes[whole + k].astype(np.uint64) * np.uint64(2) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(whole), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = whole[twice]
    edge = np.zeros(len(codes) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[covered], minlength=n_docs)


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """``NAMES`` by text; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    words = pc.ascii_split_whitespace(texts)
    bounds = words.offsets.to_numpy()
    size = np.diff(bounds)
    flat = words.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(n), size)[real]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    codes = coded.indices.to_numpy()
    out = {k: np.zeros(n, np.int64) for k in NAMES}
    out["n_words"] = np.bincount(doc, minlength=n)
    out["n_repeat_words"] = repeated_words(codes, doc, n)
    pair = np.sort(doc.astype(np.int64) << 32 | codes)
    first = np.ones(len(pair), bool)
    first[1:] = pair[1:] != pair[:-1]
    out["n_distinct"] = np.bincount(pair[first] >> 32, minlength=n)
    for i, text in enumerate(texts):
        raw = text.as_buffer()
        count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        out["word_chars"][i] = len(raw) - count[128:192].sum() - count[WHITE].sum()
        out["n_symbols"][i] = count[SYMBOLS].sum()
        out["n_upper"][i] = count[65:91].sum()
        out["n_digits"][i] = count[48:58].sum()
        out["n_punct"][i] = count[PUNCTUATION].sum()
        lines = [x for x in raw.to_pybytes().split(b"\n") if x.strip(b" \t\v\f\r")]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    return out
