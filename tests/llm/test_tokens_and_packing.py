import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracewright.llm import packing, token_files
from tracewright.llm.tokens import TOKENIZER, encoder

LIBRARY = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))


def ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab.,'\" \n\x01<|>sEÉé́ßſ"), st.characters(codec="utf-8")), max_size=40), max_size=6))
def test_ids_equal_the_library(texts):
    parts = list(encoder(TOKENIZER).encode(texts))
    flat = [i for p, _ in parts for i in p.tolist()]
    assert flat == [i for t in texts for i in ids(t)]
    assert [n for _, s in parts for n in s.tolist()] == [len(ids(t)) for t in texts]


def same(texts):
    parts = list(encoder(TOKENIZER).encode(texts))
    want = [ids(t) for t in texts]
    assert [n for _, s in parts for n in s.tolist()] == [len(w) for w in want]
    assert [i for p, _ in parts for i in p.tolist()] == [i for w in want for i in w]


def test_ids_of_letters_that_normalising_changes():
    letters = [c for c in map(chr, range(0x80, 0x30000)) if not 0xD800 <= ord(c) < 0xE000 and (unicodedata.normalize("NFC", c) != c or c.lower() != c or ord(c) < 0x250)]
    assert {"\u0130", "\u095b", "\u095c", "\u09dc", "\u0a33", "\ufb1d"} <= set(letters)
    for start in range(0, len(letters), 200):
        some = letters[start : start + 200]
        same([" ".join(f"x{c}{sign}b {c}{sign}" for c in some) + "." for sign in (", ", ". ", ".\n", ",\n")])
    marks = [chr(m) for m in range(0x300, 0x370)]
    same([" ".join(f"{a}{m}, {a}{m}b" for m in marks) for a in "AHJTWYZi1"])
    same(["KİŞİ, bu", "चीज़, यह", "बाड़. है", "a\x1c, b", "a\x1f. b", "a\u00a0, b", "a\u0085. b", "1, 2. 3.\n", "a_, b", "é, ÷, b"])


def test_ids_of_words_whose_letters_cancel_out():
    for size in (512, 1024, 2048, 4096):
        word = "".join("ab"[bin(k).count("1") % 2] for k in range(size))
        other = word.translate(str.maketrans("ab", "ba"))
        same([f"{word} two {other}", other, word])


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, docs, nothing, tmp_path, encoding):
    path = str(tmp_path / encoding)
    token_files.write_tokens(docs, path, encoding)
    got = token_files.read_tokens(spark, path).collect()
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, ids(r["text"])) for r in docs.collect())
    got.sort(key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["tokens"])
        at += len(r["tokens"])
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert keys == sorted(keys) and sorted((*k, r["tokens"]) for k, r in zip(keys, got)) == want
    crc = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in token_files.digests(token_files.read_tokens(spark, path)).collect()}
    assert all(crc[r["doc_id"], r["start"]] == zlib.crc32(np.array(r["tokens"], "<u4").tobytes()) for r in got)
    plan = token_files.read_tokens(spark, path).where("doc_id = 5").select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,5)" in plan and "tokens:array" not in plan.split("ReadSchema")[-1]
    token_files.write_tokens(nothing, str(tmp_path / f"{encoding}-empty"), encoding)
    assert token_files.read_tokens(spark, str(tmp_path / f"{encoding}-empty")).count() == 0


def test_pack_fills_and_balances():
    sizes = [5000, 1, 2048, 2049, 700, 300, 0, 1500, 40, 40, 40]
    pieces = packing.pack(sizes)
    seen = {d: [] for d in range(len(sizes))}
    used = {}
    for d, start, n, s, off in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert n > 0 and off == used.get(s, 0)
        used[s] = off + n
        seen[d].append((start, n))
    assert all(u <= 2048 for u in used.values()) and sum(2048 - u for u in used.values()) < 2048
    for d, size in enumerate(sizes):
        at = 0
        for start, n in sorted(seen[d]):
            assert start == at
            at += n
        assert at == size


def test_pack_documents(docs, nothing):
    got = packing.pack_documents(docs).collect()
    texts = {r["doc_id"]: ids(r["text"]) for r in docs.collect() if r["doc_id"] is not None}
    for r in got:
        if r["doc_id"] is not None:
            part = texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and r["doc_tokens"] == len(texts[r["doc_id"]])
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    assert sum(r["length"] for r in got) == sum(len(ids(r["text"])) for r in docs.collect())
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    for a, b in zip(places, places[1:]):
        assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0)
    assert packing.pack_documents(nothing).count() == 0


@pytest.mark.parametrize(("encoding", "name"), [("dictionary", "PLAIN_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_token_file_footers(spark, tmp_path, encoding, name):
    rows = [(i % 3 if i < 300 else i, " ".join(f"word{(i * 7 + k * k) % 999}" for k in range(1500))) for i in range(900)]
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), str(tmp_path / encoding), encoding, row_group_mb=1, page_rows=50)
    groups = 0
    for f in (tmp_path / encoding).glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        groups = max(groups, meta.num_row_groups)
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            tokens = next(c for n, c in columns.items() if n.startswith("tokens"))
            assert name in tokens.encodings and tokens.has_offset_index and columns["doc_id"].has_column_index
            assert columns["doc_id"].statistics.has_min_max and tokens.compression == "ZSTD"
    assert groups >= (2 if encoding == "delta" else 1)
    back = token_files.read_tokens(spark, str(tmp_path / encoding))
    assert [r["n_tokens"] for r in back.where("doc_id = 555").collect()] == [len(ids(rows[555][1]))] and back.where("doc_id = 1").count() == 100


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9000), max_size=40))
def test_pack_wastes_less_than_one_sequence(sizes):
    used, seen = {}, {}
    for d, start, n, s, off in packing.pack(sizes):
        used[s] = used.get(s, 0) + n
        seen[d] = seen.get(d, 0) + n
    assert all(u <= 2048 for u in used.values()) and sum(2048 - u for u in used.values()) < 2048
    assert seen == {d: n for d, n in enumerate(sizes) if n}


@pytest.mark.parametrize("most", [9000, 400])
def test_pack_balances_cost(most):
    """Pieces come largest first, each goes to the sequence of lowest cost with room; without very large ones costs differ far less than if sequences were filled in turn."""
    r = np.random.default_rng(5)
    sizes = np.minimum(r.lognormal(5, 1.2, 1500).astype(int) + 1, most).tolist()
    cost = lambda n: packing.LINEAR * n + packing.QUADRATIC * n * n
    pieces = packing.pack(sizes)
    rest = [p for p in pieces if not (p[2] == packing.SEQUENCE and p[4] == 0 and p[1] + p[2] < sizes[p[0]])]
    costs = {s: 0.0 for *_, s, _ in rest}
    used = dict.fromkeys(costs, 0)
    left = {}
    for d, start, n, s, off in rest:
        waiting = left.pop(d, sizes[d] - start)
        assert off == used[s] and costs[s] == min(c for x, c in costs.items() if used[x] < packing.SEQUENCE)
        assert n == min(waiting, packing.SEQUENCE - off)
        costs[s], used[s] = costs[s] + cost(n), used[s] + n
        if n < waiting:
            left[d] = waiting - n
    assert not left
    turn, fill, at = [0.0], 0, packing.SEQUENCE
    for size in [sizes[d] - s for d, s, *_ in sorted({(d, min(p[1] for p in rest if p[0] == d)) for d, *_ in rest})]:
        while size:
            take = min(size, at - fill)
            turn[-1], fill, size = turn[-1] + cost(take), fill + take, size - take
            if fill == at:
                turn.append(0.0)
                fill = 0
    assert most > packing.SEQUENCE or np.std(list(costs.values())) < 0.5 * np.std(turn[:-1])
