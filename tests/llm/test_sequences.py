"""Token alignment, periodic runs and byte-level BPE against brute force and the public libraries."""

import bisect
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from tests.llm.helpers import documents, edge_rows, prose, words_of
from textmine.llm import byte_bpe, periodic_runs, token_align
from textmine.llm.byte_bpe import PerfectHash, load_ranks, merge
from textmine.llm.suffix_tree import SuffixTree, runs

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  a  b", "a▁b", "日本語 😀 ñ\n\n\t x", "<|endoftext|> <s> </s> <unk> <0x41>", "\x00\x01 a", "aaaa" * 500, "a\r\nb",
    "　x\xa0y ﻿ z ﬁ ２", "é", "\x1c\x1d a\x1e\x1f b", "\x85 x ​　 y\n\n  z", "I'll can't", " " * 999, "abab" * 3000]


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def table(spark, sf=SF):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


# ------------------------------------------------------------------ byte BPE
@pytest.fixture(scope="module")
def ranks():
    return load_ranks(byte_bpe.MODEL_FILE)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_both_vocabulary_files_hold_the_same_ranks(ranks):
    assert load_ranks(public_tokenizers.path("byte_bpe_50k.json")) == ranks


def test_perfect_hash_is_minimal_and_rejects_strangers(ranks):
    import pyarrow as pa

    keys = list(ranks)
    table_ = PerfectHash(keys)
    found = table_.find(pa.array(keys, pa.large_binary()))
    assert sorted(found.tolist()) == list(range(len(keys)))
    assert [keys[i] for i in table_.order[found]] == keys
    strangers = [k + b"\xff\x00q" for k in keys if k + b"\xff\x00q" not in ranks] + [b""]
    assert set(table_.find(pa.array(strangers, pa.large_binary())).tolist()) == {-1}
    assert PerfectHash([]).find(pa.array([b"x"], pa.large_binary())).tolist() == [-1]


def test_merge_takes_the_lowest_rank_then_the_leftmost(ranks):
    def slow(word):
        parts = [word[i:i + 1] for i in range(len(word))]
        while True:
            best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(4)
    for _ in range(400):
        word = bytes(rng.choice(b"aabethinr sd\xc3\xa9") for _ in range(rng.randint(1, 60)))
        assert merge(word, ranks) == slow(word)
    assert merge(b"", ranks) == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ids_equal_the_library(spark, name):
    path = public_tokenizers.path(name)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    rng = random.Random(1)
    rows = list(enumerate(ODD + [t for _, t in table(spark)] + ["".join(
        chr(rng.choice([32, 10, 97, 98, 0x1C, 0x85, 0xA0, 0x2028, 0x3000, 0x1D7D8, 0x661, 0x10330, 0xE9, 0x4E00, 39, 115])) for _ in range(200))
        for _ in range(50)]))
    made = byte_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), model_file=path)
    got = {r.doc_id: (r.n_tokens, list(r.ids)) for r in made.collect()}
    for i, text in rows:
        want = lib.encode_ordinary(text or "")
        assert got[i] == (len(want), want)
    back = {r.doc_id: bytes(r.payload) for r in byte_bpe.decode(made, model_file=path).collect()}
    assert all(back[i] == (t or "").encode() for i, t in rows)


def test_byte_bpe_query(spark, library):
    got = {tuple(r) for r in byte_bpe.query(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    want = set()
    for i, text in table(spark):
        ids = library.encode_ordinary(text or "")
        want.add((i, len(ids), sha(" ".join(map(str, ids))), sha(text or "")))
    assert got == want


def test_byte_bpe_edges(spark, library):
    docs = documents(spark, edge_rows())
    out = byte_bpe.encode(docs)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() == len(edge_rows())
    by = {(r.doc_id, r.n_tokens) for r in out.collect()}
    assert by == {(i, len(library.encode_ordinary(t or ""))) for i, t in edge_rows()}
    assert byte_bpe.encode(documents(spark, [])).count() == 0
    assert byte_bpe.decode(byte_bpe.encode(documents(spark, []))).count() == 0


def test_a_vocabulary_without_all_bytes_is_refused(spark, tmp_path):
    (tmp_path / "few.tiktoken").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="bytes without a token"):
        byte_bpe.broadcast_vocabulary(spark, str(tmp_path / "few.tiktoken"))


# -------------------------------------------------------------- periodic runs
def slow_runs(s):
    n, out = len(s), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j - i >= q:
                a, length = i, j - i + q
                if not any(all(s[k] == s[k + p] for k in range(a, a + length - p)) for p in range(1, q)):
                    out.add((a, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_all_runs_of_sequences():
    rng = random.Random(1)
    for t in range(800):
        alphabet = rng.choice([1, 2, 3, 5])
        s = [rng.randrange(alphabet) for _ in range(rng.randint(0, 40))]
        if t % 3 == 0:
            block = s[:rng.randint(1, 6)] or [0]
            s = s + block * rng.randint(2, 6) + s[:3]
        assert list(map(tuple, runs(s).tolist())) == slow_runs(s)


def test_extensions_are_common_prefixes():
    rng = random.Random(2)
    s = [rng.randrange(2) for _ in range(120)]
    tree = SuffixTree(s)
    a, b = np.array([(i, j) for i in range(121) for j in range(121) if i != j]).T
    want = [next((k for k in range(121) if max(i, j) + k >= 120 or s[i + k] != s[j + k]), 0) for i, j in zip(a, b, strict=True)]
    assert tree.extensions(a, b).tolist() == want
    assert [s[i:] for i in np.argsort(tree.rank).tolist()] == sorted(s[i:] for i in range(121))


def strong(ws, exponent=4, least=6):
    return [r for r in slow_runs(ws) if r[1] >= max(least, exponent * r[2])]


def collapsed(ws, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 4), (3, 9)])
def test_runs_of_texts_equal_brute_force(spark, exponent, least):
    rng, rows = random.Random(exponent), []
    for i in range(150):
        ws = [rng.choice("a b c the".split() if i % 2 else words_of(prose(rng, 30))) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            at, block = rng.randint(0, len(ws)), [rng.choice("xyzab") for _ in range(rng.randint(1, 5))]
            ws[at:at] = (block * 9)[:len(block) * rng.randint(2, 6) + rng.randint(0, 2)]
        rows.append((i, rng.choice([" ", "  \n", "\t"]).join(ws)))
    out = periodic_runs.find_runs(documents(spark, rows), exponent=exponent, min_length=least)
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()}
    some = 0
    for i, text in rows:
        ws = words_of(text)
        found = strong(ws, exponent, least)
        some += bool(found)
        assert got[i] == (len(ws), found, collapsed(ws, found))
    assert some > 50


def plant(i, text):
    ws, h = words_of(text), zlib.crc32(str(i).encode())
    if h % 10 == 0 and ws:
        n, g = len(ws), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if k < a else ws[a + (k - a) % p] for k, w in enumerate(ws)]
    return ws


def fast_strong(ws, exponent=4, least=6):
    """Runs by comparing the sequence with itself at every distance; longer periods of a stretch found before go."""
    codes = np.unique(ws, return_inverse=True)[1] if ws else np.zeros(0, dtype=int)
    out = []
    for q in range(1, len(ws) // exponent + 1):
        same = np.concatenate([[False], codes[q:] == codes[:-q], [False]]).astype(int)
        first, last = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for a, n in zip(first.tolist(), (last - first + q).tolist(), strict=True):
            if n >= max(least, exponent * q) and not any(q % p == 0 and (a, n) == (x, m) for x, m, p in out):
                out.append((a, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_periodic_runs_query(spark):
    got = {r.doc_id: r for r in periodic_runs.query(spark, SF).collect()}
    rows = table(spark)
    assert len(got) == len(rows)
    planted = 0
    for i, text in rows:
        ws = plant(i, text)
        found = fast_strong(ws)
        planted += bool(found)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want = (i, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
                sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(collapsed(ws, found)))
        assert tuple(got[i]) == want
    assert planted >= 10


def test_periodic_runs_edges(spark):
    block = "red green blue"
    rows = edge_rows() + [(11, " ".join(["x"] * 6)), (12, " ".join(["x"] * 5)), (13, f"{block} " * 4), (14, f"{block} " * 3 + "red green"),
                          (15, (prose(random.Random(6), 500) + " ") * 40)]
    out = periodic_runs.find_runs(documents(spark, rows))
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"] and out.count() == len(rows)
    by = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in out.collect()}
    assert by[1] == by[2] == by[3] == ([], "") and by[11] == ([(0, 6, 1)], "x") and by[12][0] == [] and by[14][0] == []
    assert by[13] == ([(0, 12, 3)], block) and by[15] == ([(0, 20_000, 500)], rows[-1][1].split(" " + rows[-1][1][:40])[0])
    assert periodic_runs.find_runs(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(documents(spark, []), exponent=1)


# ------------------------------------------------------------------ alignment
def slow_alignment(rows):
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letter = byte_bpe._byte_letters()

    def one_bytes(i):
        return bytes(letter[c] for c in one.id_to_token(i))

    def two_bytes(i):
        piece = two.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if two.is_byte(i) else piece.replace("▁", " ").encode()

    def ends(tokens):
        return np.cumsum([len(t) for t in tokens]).tolist()

    made, count = [], Counter()
    for key, text in rows:
        a = b = []
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
            want = (" " + text).encode()
            if b"".join(map(one_bytes, a)) != want or b"".join(map(two_bytes, b)) != want:
                a = b = []
        ea, eb = ends(map(one_bytes, a)), ends(map(two_bytes, b))
        links, j = [], 0
        for i, end in enumerate(ea):
            begin = ea[i - 1] if i else 0
            while j < len(eb) and eb[j] <= begin:
                j += 1
            k = j
            while k < len(eb) and (eb[k - 1] if k else 0) < end:
                links.append((a[i], b[k]))
                k += 1
        cuts = sorted(set(ea) & set(eb))
        groups = [([], []) for _ in cuts]
        for side, (ids, at) in enumerate(((a, ea), (b, eb))):
            for token, end in zip(ids, at, strict=True):
                groups[bisect.bisect_left(cuts, end)][side].append(str(token))
        line = ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)
        made.append((key, len(a), len(b), len(cuts), links, sha(line) if a else ""))
        count.update(set(links))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    rows = [(k, a, b, g, len(ls), sum(count[x] == top[x[0]] for x in ls), sum(count[x] for x in ls), s) for k, a, b, g, ls, s in made]
    return rows, count


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r))


def test_alignment_query(spark):
    want, _ = slow_alignment(table(spark))
    assert in_order(token_align.query(spark, SF).collect()) == in_order(want)


@pytest.mark.parametrize("block", [1, 400, 16 << 20])
def test_alignment_of_odd_texts_in_any_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(token_align, "BLOCK_BYTES", block)
    monkeypatch.setattr(token_align, "SLICE_BYTES", min(block, 200))
    rows = list(enumerate(ODD + ["the cat sat on the mat"] * 5 + ["aa aa aaa aaaa a" * 3] * 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, count = slow_alignment(rows)
    assert in_order(token_align.align(docs).collect()) == in_order(want)
    assert {(r.a, r.b): r.docs for r in token_align.pair_counts(docs).collect()} == dict(count)


def test_alignment_edges(spark):
    docs = documents(spark, edge_rows())
    out = token_align.align(docs)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert in_order(out.collect()) == in_order(slow_alignment(edge_rows())[0])
    assert token_align.align(documents(spark, [])).count() == 0
    nothing = token_align.align(documents(spark, [(1, None), (2, ""), (3, "▁")]))
    assert {tuple(r) for r in nothing.collect()} == {(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)}


def test_identity_map_prefers_whole_pieces():
    found = token_align.identity_map([b"a", b" b", b"zz", b"", b"\xff"], [b"a", b"a", b" b", b"\xff"], [0, 3])
    assert found.tolist() == [1, 2, -1, -1, 3]
