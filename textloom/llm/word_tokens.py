"""Token ids of whole texts by a public ``tokenizers`` file, word by word.

The vocabulary's normaliser and pre-tokeniser never join characters across
ASCII white space, so a text's ids are its words' ids one after another.  Each
Arrow batch is split and dictionary-encoded by Arrow; only words that the
worker has not met are given to the library.

Where the file's rules are ``RULES``, a word of letters (of ASCII and Latin-1)
and ASCII punctuation after them is cut in two there, as the rules cut it, and
its letters are lower-cased, as the rules do: far fewer pieces than words are
new, and these go to the library's model without the rules, which would change
nothing more.  All other words go to the library as they are.
"""

from __future__ import annotations

import json
import os
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers; beyond, pieces are encoded by batch.
CACHE_WORDS = 300_000
#: Pieces of more bytes are encoded each time and not remembered, so the memory is bounded in bytes too.
CACHE_WORD_BYTES = 64
#: Unknown pieces that go to the library as one text.
WORDS_A_LINE = 200

#: The rules under which words may be cut and lower-cased here.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
MARKS = string.punctuation
#: Letters that NFC leaves alone and whose lower case is one of them; and what is left of a word after the cut.
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]*$"
PIECE = "^(?:[a-zß-öø-ÿ]*|[!-/:-@\\[-`{-~]*)$"
#: The character that the byte-level rule writes for each byte.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = np.array([b if b in _SHOWN else 256 + b - sum(x < b for x in _SHOWN) for b in range(256)], "<u4")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bytes_by(ids: np.ndarray, lens: np.ndarray) -> pa.LargeBinaryArray:
    """``ids`` cut at ``lens``, as byte strings, which Arrow gathers faster than numpy gathers runs of ids."""
    cuts = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)]) * ids.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(cuts), pa.py_buffer(ids)])


def offsets(a: pa.Array) -> np.ndarray:
    """Where the strings of a large array begin and end in its data."""
    return np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)


class WordEncoder:
    """Encodes batches of texts to one flat id array and lengths by text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.model, self.last = self._model()
        # known pieces, and their ids one after another; a word without punctuation has an empty second piece
        self.known = pa.array([""], pa.large_string())
        self.flat, self.lens = np.zeros(0, self.dtype), np.zeros(1, np.int32)

    def _model(self):
        """The file's model alone, and which of its ids end a piece; None where its rules are others."""
        from tokenizers import Tokenizer, pre_tokenizers

        rules = json.loads(self.tokenizer.to_str())
        suffix = rules["model"].get("end_of_word_suffix")
        # no added token may lie within letters and punctuation after them
        inside = pa.array([t["content"].rstrip(MARKS) for t in rules["added_tokens"]], pa.string())
        if not suffix or any(rules[k] != v for k, v in RULES.items()) or pc.any(pc.match_substring_regex(inside, LETTERS)).as_py():
            return None, None
        model = Tokenizer(self.tokenizer.model)
        model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(chr(BYTE_CHARS[ord("\n")]))
        vocab = model.get_vocab()
        last = np.zeros(max(vocab.values()) + 1, bool)
        last[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        return model, last

    def _by_library(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and their number by word; a line of words is one call to the library."""
        flat, lens, words = [np.zeros(0, self.dtype)], [np.zeros(0, np.int32)], words.to_pylist()
        for i in range(0, len(words), WORDS_A_LINE):
            line = words[i : i + WORDS_A_LINE]
            e = self.tokenizer.encode("\n".join(line), add_special_tokens=False)
            begin = np.cumsum([0, *(len(w) + 1 for w in line[:-1])])
            at = np.fromiter((o[0] for o in e.offsets), np.int64, len(e))
            lens.append(np.bincount(np.searchsorted(begin, at, "right") - 1, minlength=len(line)).astype(np.int32))
            flat.append(np.array(e.ids, self.dtype))
        return np.concatenate(flat), np.concatenate(lens)

    def _by_model(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces that the rules would leave as they are; an id tells whether it is its piece's last."""
        cuts = np.append(np.arange(0, len(pieces), WORDS_A_LINE), len(pieces))
        flat = [np.zeros(0, self.dtype)]
        for line in pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pieces), pa.scalar("\n", pa.large_string())):
            chars = BYTE_CHARS[np.frombuffer(line.as_buffer(), np.uint8)].tobytes().decode("utf-32-le")
            flat.append(np.array(self.model.encode_batch_fast([chars], add_special_tokens=False)[0].ids, self.dtype))
        ids = np.concatenate(flat)
        lens = np.diff(np.flatnonzero(self.last[ids]), prepend=-1).astype(np.int32)
        if len(lens) != len(pieces) or lens.sum() != len(ids):  # a vocabulary without some byte
            return self._by_library(pieces)
        return ids, lens

    def _pieces(self, words: pa.Array) -> pa.Array:
        """Two pieces a word: lower-cased letters and the punctuation after them; or the word as it is, and nothing."""
        at = offsets(words)
        size = np.diff(at)
        stem = pc.ascii_rtrim(words, characters=MARKS)
        plain = pc.match_substring_regex(stem, LETTERS).to_numpy(zero_copy_only=False) & (self.model is not None)
        cuts = np.empty(2 * len(words) + 1, np.int64)
        cuts[0::2] = at
        cuts[1::2] = at[:-1] + np.where(plain, np.diff(offsets(stem)), size)
        pieces = pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(cuts), words.buffers()[2])
        return pc.if_else(pa.array(np.repeat(plain, 2)), pc.utf8_lower(pieces), pieces)

    def _remember(self, pieces: pa.Array, ids: np.ndarray, n: np.ndarray) -> None:
        """Keeps the short ones of new pieces with their ids, and nothing of the others."""
        keep = np.flatnonzero(pc.less_equal(pc.binary_length(pieces), CACHE_WORD_BYTES).to_numpy(zero_copy_only=False))
        keep = keep[: max(0, CACHE_WORDS - len(self.known))]
        if len(keep):
            own = np.zeros(len(n), bool)
            own[keep] = True
            self.lens = np.concatenate([self.lens, n[keep]])
            self.flat = np.concatenate([self.flat, ids[np.repeat(own, n)]])
            self.known = pa.concat_arrays([self.known, pieces.take(pa.array(keep))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, n)``: all ids in order, and each text's count; null texts are empty."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        bounds = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        pieces = self._pieces(coded.dictionary).dictionary_encode()
        uniq = pieces.dictionary
        slot = pc.fill_null(pc.index_in(uniq, value_set=self.known), -1).to_numpy().copy()
        new = np.flatnonzero(slot < 0)
        flat, lens = self.flat, self.lens
        if len(new):
            some = uniq.take(pa.array(new))
            plain = pc.match_substring_regex(some, PIECE).to_numpy(zero_copy_only=False) & (self.model is not None)
            for own, run in ((plain, self._by_model), (~plain, self._by_library)):
                if own.any():
                    part = some.filter(pa.array(own))
                    extra, n = run(part)
                    slot[new[own]] = len(lens) + np.arange(len(part))
                    flat, lens = np.concatenate([flat, extra]), np.concatenate([lens, n])
                    self._remember(part, extra, n)
        a_piece = bytes_by(flat, lens).take(pa.array(slot[pieces.indices.to_numpy()]))
        a_word = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(coded.dictionary), [None, pa.py_buffer(offsets(a_piece)[::2].copy()), a_piece.buffers()[2]])
        out = a_word.take(coded.indices)
        ends = offsets(out) // flat.itemsize
        ids = np.frombuffer(out.buffers()[2] or b"", flat.dtype, int(ends[-1])).copy()
        counts = np.diff(ends[bounds - bounds[0]])
        del words, coded, pieces, uniq, slot, a_piece, a_word, out, ends
        pa.default_memory_pool().release_unused()
        return ids, counts


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's own encoder: loaded once, its memory of words serves all its tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
