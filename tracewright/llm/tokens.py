"""Token ids of whole texts, one white-space chunk at a time, with a bounded cache of chunks."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from tracewright.llm.words import CASED, Words, words

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Distinct chunks that one Python worker remembers; then it starts afresh.
CACHE_CHUNKS = 500_000
#: Bytes of text that are prepared at a time.
SLICE_BYTES = 1_000_000
#: Chunks between two separators in one call of the tokenizer.
RUN = 500
#: A stop or comma between a letter or digit and a blank. Only letters that normalising leaves as they are count: ASCII, and the
#: two-byte ones from sharp s to y with diaeresis (the sign in their midst left out); elsewhere the sign may join a mark.
_SIGN = re.compile(rb"[.,](?:(?<=[A-Za-z0-9].)|(?<=\xc3[\x9f-\xb6\xb8-\xbf].))(?=[ \n])")
#: First bytes of combining marks, with which a capital may stand that has no composed form where the small letter has one.
_MARKS = (b"\xcc", b"\xcd")


def loosened(text: str) -> bytes:
    """The text in other words with equal ids: A-Z lower-cased, a lone stop or comma set apart.

    The tokenizer lower-cases anyway and makes a word of its own of each run of signs, so only the
    number of distinct chunks changes. Texts that could name special tokens, or hold combining marks, keep their case.
    """
    raw = _SIGN.sub(rb" \g<0>", text.encode("utf-8", "replace"))
    return raw if b"<|" in raw or any(m in raw for m in _MARKS) else raw.lower()


class ChunkEncoder:
    """Ids of texts under a tokenizer whose words never cross ASCII white space.

    The tokenizer normalises and splits at white space before it merges, so the ids of a text are the
    ids of its chunks in turn, and each distinct chunk is tokenised once. Chunks are found and looked
    up by two 64-bit hashes over whole slices of text. New chunks go to the library many at a time, with
    a separator word between them whose single id marks where a chunk ends. Lower-case Latin words
    need no normalising or splitting, so they go to the library's model straight.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        self.library = Tokenizer.from_file(path)
        self.straight = Tokenizer.from_file(path)
        self.straight.normalizer = normalizers.Sequence([])
        self.straight.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {b: alphabet.pre_tokenize_str(chr(b))[0][0][-1] for b in range(0x21, 0x7F)}
        for b in range(0x80, 0x100):  # the last byte of a two-byte character, and the first
            pair = (bytes([0xC3, b]) if b < 0xC0 else bytes([b, 0x80])).decode("utf-8", "replace")
            if "\ufffd" not in pair:
                self.letters[b] = alphabet.pre_tokenize_str(pair)[0][0][1 if b < 0xC0 else 0]
        self.mark = self._ids("\x01")
        if len(self.mark) != 1 or self._ids("a \x01 b") != [*self._ids("a"), *self.mark, *self._ids("b")]:
            raise ValueError("this tokenizer has no separator of one id")
        self.forget()

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.names = self.checks = np.empty(0, np.uint64)
        self.codes = np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)
        self.starts = self.sizes = np.empty(0, np.int64)

    def _many(self, library: Tokenizer, runs: list[str], count: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of chunks that stand in runs with a separator after each."""
        ids = [np.array(e.ids, np.int32) for e in library.encode_batch_fast(runs, add_special_tokens=False)]
        ids = np.concatenate([np.empty(0, np.int32), *ids])
        stops = np.flatnonzero(ids == self.mark[0])
        if len(stops) != count:
            raise ValueError("the tokenizer joined chunks across white space")
        return ids[ids != self.mark[0]], np.diff(stops, prepend=-1) - 1

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of chunks, in their order."""
        kind = np.array([2 if "\x01" in c else 0 if c.isalpha() and c.islower() and max(c) < "\u0250" else 1 for c in chunks])
        parts = []
        for k, library in ((0, self.straight), (1, self.library)):
            these = [chunks[i] for i in np.flatnonzero(kind == k)]
            runs = [these[i : i + RUN] for i in range(0, len(these), RUN)]
            if k == 0:
                sign = " " + self.alphabetic("\x01") + " "
                runs = [self.alphabetic(" ".join(r)).replace(" ", sign) + sign if unicodedata.is_normalized("NFC", " ".join(r)) else None for r in runs]
                if None in runs:
                    kind[kind == 0] = 1
                    parts.append((np.empty(0, np.int32), np.empty(0, np.int64)))
                    continue
            else:
                runs = [" \x01 ".join([*r, ""]) for r in runs]
            parts.append(self._many(library, runs, len(these)))
        odd = [np.array(self._ids(chunks[i]), np.int32) for i in np.flatnonzero(kind == 2)]
        parts.append((np.concatenate([np.empty(0, np.int32), *odd]), np.array([len(o) for o in odd], np.int64)))
        order = np.argsort(np.argsort(kind, kind="stable"))
        flat, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        starts = np.cumsum(sizes) - sizes
        sizes, starts = sizes[order], starts[order]
        ends = np.cumsum(sizes)
        return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(int(sizes.sum()))], sizes

    def alphabetic(self, text: str) -> str:
        """The text in the model's alphabet, which has one character for each byte; spaces stay."""
        if text == "\x01":
            return self.library.id_to_token(self.mark[0]).removesuffix("</w>")
        return text.encode().decode("latin-1").translate(self.letters)

    def _lookup(self, w: Words) -> np.ndarray | None:
        """The number of each word; None if two words have one hash."""
        second = w.second
        names, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        checks = second[first]
        if (second != checks[inverse]).any():
            return None
        at = np.minimum(np.searchsorted(self.names, names), max(len(self.names) - 1, 0))
        known = self.names[at] == names if len(self.names) else np.zeros(len(names), bool)
        if (self.checks[at[known]] != checks[known]).any():
            return None
        code = np.empty(len(names), np.int64)
        code[known] = self.codes[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = w.data.tobytes()
            flat, sizes = self._learn([raw[a:b].decode("utf-8", "replace") for a, b in zip(w.starts[first[new]].tolist(), w.ends[first[new]].tolist())])
            code[new] = len(self.sizes) + np.arange(len(new))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
            place = np.searchsorted(self.names, names[new])
            self.names, self.checks, self.codes = (np.insert(a, place, b) for a, b in ((self.names, names[new]), (self.checks, checks[new]), (self.codes, code[new])))
        return code[inverse]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of all texts, each followed by END_ID, and the number of ids of each text; slice by slice."""
        for w in words(pa.array([loosened(t) for t in texts], pa.large_binary()), CASED, twice=True):
            if len(self.names) > CACHE_CHUNKS:
                self.forget()
            code = self._lookup(w)
            if code is None:
                ids = [np.array([*self._ids(t), END_ID], np.int32) for t in texts[w.first : w.first + len(w.counts)]]
                yield np.concatenate(ids), np.array([len(x) for x in ids], np.int64)
                continue
            sizes = self.sizes[code]
            ends = np.cumsum(sizes)
            total = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(w.counts)])]
            rows = np.arange(len(w.counts))
            out = np.full(int(total[-1]) + len(rows), END_ID, np.int32)
            index = np.arange(int(total[-1]))
            out[index + np.repeat(rows, np.diff(total))] = self.flat[index + np.repeat(self.starts[code] - ends + sizes, sizes)]
            yield out, np.diff(total) + 1


_encoders: dict[str, ChunkEncoder] = {}


def encoder(name: str) -> ChunkEncoder:
    """The worker's encoder for a public tokenizer file; kept while the worker lives."""
    if name not in _encoders:
        _encoders[name] = ChunkEncoder(public_tokenizers.path(name))
    return _encoders[name]


def encoded(batch: pa.RecordBatch, name: str = TOKENIZER) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, ids per row) for runs of rows of a batch with a column text; null: empty."""
    column = batch.column(batch.schema.names.index("text"))
    first, held, texts = 0, 0, []
    for i, text in enumerate(column):
        texts.append(text.as_py() or "")
        held += len(texts[-1])
        if held >= SLICE_BYTES or i + 1 == len(column):
            for ids, sizes in encoder(name).encode(texts):
                yield first, ids, sizes
                first += len(sizes)
            held, texts = 0, []
