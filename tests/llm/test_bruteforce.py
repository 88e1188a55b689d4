"""Operators against brute-force versions, exact round trips and held-out accuracy."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.helpers import documents, prose, words_of
from textmine.llm import (
    chat_format, decontaminate, ngram_join, piece_codec, quality_classifier, quality_rules, secret_scan,
    substring_dedup, url_filter, warc, wordhash)
from textmine.llm.components import connected_components
from textmine.llm.piece_lattice import Decoder, Lattice, load_vocabulary, normalise
from textmine.llm.suffix_automaton import SuffixAutomaton

SF = "/root/testdata/sf0.001"


# -- words -------------------------------------------------------------------------------

def test_word_hashes_split_like_bytes_split():
    texts = ["", " a  b\n", None, "é ß\x0b日本\x0c x" + "y" * 90, "\x1ca b c", "x" * 200 + " " + "x" * 199]
    seen = {}
    for a, b, data, offsets in wordhash.text_slices(pa.array(texts), slice_bytes=8):
        hashes, bounds, start, stop = wordhash.word_hashes(data, offsets)
        for r in range(b - a):
            own = [bytes(data[start[i]:stop[i]]) for i in range(bounds[r], bounds[r + 1])]
            assert own == (texts[a + r] or "").encode().split()
            for w, h in zip(own, hashes[bounds[r]:bounds[r + 1]], strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 50])
def test_window_hashes_are_equal_for_equal_windows_only(size):
    rng = np.random.default_rng(1)
    words = wordhash.mix(rng.integers(0, 3, size=400).astype(np.uint64))
    made = wordhash.window_hashes(words, size)
    runs = [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]
    assert len(made) == len(runs) and len(set(zip(runs, made.tolist()))) == len(set(runs)) == len(set(made.tolist()))


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8, 35])
def test_sliding_min_positions(width):
    values = np.random.default_rng(2).integers(0, 9, size=60).astype(np.uint64)
    want = [i + int(np.argmin(values[i:i + width])) for i in range(len(values) - width + 1)]
    assert wordhash.sliding_min_positions(values, width).tolist() == want


# -- 1: quality rules ----------------------------------------------------------------------

def rule_counts(text):
    w = words_of(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    again = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))


def test_quality_counts(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(" ".join(rng.choice("ab*c|d#") * rng.randint(1, 2) for _ in range(rng.randint(0, 9)))
                          for _ in range(rng.randint(0, 6)))) for i in range(60)]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
           for r in quality_rules.counts(documents(spark, rows)).collect()}
    assert got == {i: rule_counts(t) for i, t in rows}


# -- 2: secret scans -----------------------------------------------------------------------

BASE = [(re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
        (re.compile(r"AKIA[A-Z0-9]+"), 0, 16), (re.compile(r"[0-9a-f]+"), 0, 32)]


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (p, g, least) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= least)


SECRETS = ["token=secret:abcdefgh12 x", 'é Token = "' + "0af9" * 10 + '" 😀 AKIA' + "Z" * 12, "AKIAAKIA" + "9" * 11 + " AKIA123", "api_key: short",
           "apikey='longenough.value' passwd==x password:=y12345678", "f" * 31 + " " + "f" * 33 + "g" + "0" * 40, None, "", "gh" + "p_" + "A1" * 20,
           "-----BEGIN RSA PRIVATE KEY-----", "clean"]


def test_secret_spans(spark):
    df = documents(spark, list(enumerate(SECRETS)))
    found = {r.doc_id: r for r in secret_scan.findings(df, secret_scan.scan_unseen(df)).collect()}
    for i, text in enumerate(SECRETS):
        assert [(s.start, s.kind, s.end) for s in found[i].spans if s.kind < 3] == base_spans(text)
    assert [s.kind for s in found[8].spans] == [3] and [s.kind for s in found[9].spans] == [6]
    out = {r.doc_id: r.text for r in secret_scan.redact(df, secret_scan.scan_unseen(df)).collect()}
    assert out[1] == "é [SECRET]\" 😀 [SECRET]" and out[10] == "clean" and out[6] is None
    for text in out.values():
        assert not base_spans(text)


def test_secret_ledger_scans_only_what_is_unseen(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    old = documents(spark, [(1, SECRETS[0]), (2, "clean")])
    first = secret_scan.update_ledger(old, path)
    assert first.count() == 2
    both = documents(spark, [(1, SECRETS[0]), (3, SECRETS[1]), (4, "clean"), (5, SECRETS[1])])
    assert [r.blob for r in secret_scan.scan_unseen(both, first).collect()] == [hashlib.sha256(SECRETS[1].encode()).hexdigest()]
    ledger = secret_scan.update_ledger(both, path)
    assert ledger.count() == 3
    assert {r.doc_id: len(r.spans) for r in secret_scan.findings(both, ledger).collect()} == {1: 0, 3: 3, 4: 0, 5: 3}
    assert secret_scan.scan_unseen(both, ledger, rule_version="next").count() == 3


# -- 3: SentencePiece ----------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(piece_codec.MODEL_FILE)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL_FILE)


HARD = ["", " ", "  a  ", "a\x00b", "\n\n x\t\ty  \r\n", "日本語のテキスト 梦想" * 9, "x" * 300, "    " * 9 + "def f():\n        return 1",
        "😀😀 é́", "aaaaaaabbbbabab" * 40, "<0x0A> <s> </s>", "thththerherthe" * 50, "word\nline\t\t x" * 20]


def chunked(lattice, text, chunk):
    whole, context = normalise(text), lattice.longest
    pieces, transfers = [], []
    for start in range(0, len(whole), chunk):
        offset, end = max(0, start - context), min(start + chunk, len(whole))
        pieces.append((whole[offset:start + chunk + context], start, offset, end))

        def moved(s, by=offset):
            return None if s is None else (s[0] + by, s[1] + by)

        transfers.append({(moved(x), moved(y)): w for (x, y), w in
                          piece_codec.transfer(lattice, pieces[-1][0], start - offset, end - offset).items()})
    out = b""
    for (piece, start, offset, end), (x, y) in zip(pieces, piece_codec.border_states(transfers) if transfers else [], strict=True):
        def local(s, by=offset):
            return None if s is None else (s[0] - by, s[1] - by)

        out += piece_codec.trace_back(lattice, piece, start - offset, end - offset, local(x), local(y))
    return np.frombuffer(out, dtype=np.int32).tolist()


def test_piece_ids_are_the_librarys(spark, vocabulary, library):
    texts = HARD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    lattice, decoder = Lattice(vocabulary), Decoder(vocabulary)
    for text in texts:
        ids = np.frombuffer(lattice.encode(text), dtype=np.int32).tolist()
        assert ids == library.encode(text)
        assert decoder.decode(ids) == text
    for text in HARD + texts[-20:]:
        for chunk in (17, 40):
            assert chunked(lattice, text[:1500], chunk) == library.encode(text[:1500])


def test_unigram_lattice_finds_the_best_path_across_chunks():
    rng = random.Random(5)
    pieces = {c: (i, -5.0) for i, c in enumerate("▁abc")}
    for n in range(60):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(2, 4)))
        pieces.setdefault(p if n % 3 else "▁" + p, (len(pieces), -rng.uniform(2, 9)))
    vocabulary = {"pieces": pieces, "bytes": [99] * 256, "unknown": 99, "size": 100}
    lattice = Lattice(vocabulary, "unigram")
    score = {i: s for i, s in pieces.values()}

    def best(text):
        reach = [0.0] + [float("-inf")] * len(text)
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + 5) + 1):
                if text[i:j] in pieces:
                    reach[j] = max(reach[j], reach[i] + pieces[text[i:j]][1])
        return reach[-1]

    for _ in range(30):
        text = "".join(rng.choice("aabbc ") for _ in range(rng.randint(1, 60)))
        for ids in (np.frombuffer(lattice.encode(text), dtype=np.int32).tolist(), chunked(lattice, text, 7)):
            assert sum(score[i] for i in ids) == pytest.approx(best(normalise(text)))


def test_codec_on_chunks_of_giant_rows(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id: r.ids for r in piece_codec.encode(docs, chunk=500).collect()}
    assert out == {i: library.encode(t) for i, t in texts.items()}


# -- 4: chats ------------------------------------------------------------------------------

def test_viterbi_is_the_best_of_all_paths():
    rng = random.Random(6)
    hmm = chat_format.Hmm({("step", a, b): rng.randint(0, 9) for a in range(6) for b in range(6)}
                          | {("marker", a, b): rng.randint(0, 9) for a in range(6) for b in range(4)}
                          | {("shape", a, b): rng.randint(0, 9) for a in range(6) for b in range(chat_format.N_SHAPES)}
                          | {("start", 0, a): rng.randint(1, 9) for a in range(6)})
    lines = ["User: hi?", "more", "", "Assistant: x", "System: y"]
    emit = hmm.emissions(lines)

    def score(path):
        return hmm.start[path[0]] + emit[0][path[0]] + sum(hmm.step[a, b] + emit[i + 1][b] for i, (a, b) in enumerate(itertools.pairwise(path)))

    want = max(itertools.product(range(6), repeat=5), key=score)
    assert score(hmm.path(lines, None, None)) == pytest.approx(score(want))
    parts = [hmm.transfer(lines[:2], True), hmm.transfer(lines[2:3], False), hmm.transfer(lines[3:], False)]
    states = []
    for (x, y), part in zip(chat_format.borders(parts, None, None), (lines[:2], lines[2:3], lines[3:]), strict=True):
        states += hmm.path(part, x, y)
    assert score(states) == pytest.approx(score(want))


@pytest.mark.parametrize("rows", [512, 2])
def test_chat_round_trip(spark, monkeypatch, rows):
    monkeypatch.setattr(chat_format, "BLOCK_ROWS", rows)
    src = spark.read.parquet(f"{SF}/conversations.parquet")
    out = chat_format.format_chats(src)
    want = {(r.conv_id, r.turn, r.role, f"<|{r.role}|>\n{r.text}<|end|>") for r in src.collect()}
    assert {(r.conv_id, r.turn, r.role, r.rendered) for r in out.collect()} == want


def test_turns_do_not_depend_on_blocks(spark, monkeypatch):
    rows = [(c, k, None if k % 6 else ("user" if c == 1 else "assistant"), f"line {k} of {c}" + "?" * (k % 6 == 1)) for c in (1, 2, None) for k in range(24)]
    rows += [(3, k, ("user", "assistant")[k % 2], f"a{k}\nb" * (1 + k % 3)) for k in range(9)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = []
    for size in (512, 2, 1):
        monkeypatch.setattr(chat_format, "BLOCK_ROWS", size)
        held = chat_format.staged(chat_format.blocks(chats, "conv_id", "turn", "role", "text"), "blocks")
        hmm = chat_format.train(held)
        made.append((hmm.start.tolist(), hmm.step.tolist(), sorted(map(str, chat_format.format_chats(chats).collect()))))
    assert any(r.count("line") > 2 for r in made[0][2])
    assert made[1] == made[0] and made[2] == made[0]


# -- 5: n-gram join ------------------------------------------------------------------------

def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.99)):
        bands, rows = ngram_join.choose_bands(threshold, recall, 192)
        assert bands * rows <= 192 and 1 - (1 - threshold**rows) ** bands >= recall


def near_copies(rng, n):
    base = [prose(rng, 60).split() for _ in range(4)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "edit" + str(rng.randint(0, 9))
        rows.append((i, " ".join(words)))
    return rows + [(n + i, prose(rng, 30)) for i in range(20)]


def jaccard_classes(rows, size=5, threshold=0.8):
    sets = {i: {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if (w := words_of(t)) else set() for i, t in rows}
    links = {i: [j for j in sets if j != i and sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold] for i in sets}
    root = {}
    for i in sorted(sets):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = i
                todo += links[x]
    return {i: (root[i], len(links[i])) for i in sets}


@pytest.mark.parametrize("bucket,block", [(32, 256), (2, 8), (1, 3)])
def test_join_links_and_classes(spark, bucket, block):
    rows = near_copies(random.Random(7), 80)
    out = ngram_join.join(documents(spark, rows), bucket=bucket, block=block)
    assert {r.doc_id: (r.class_id, r.n_links) for r in out.collect()} == jaccard_classes(rows)


def test_of_repeated_ids_the_row_that_chose_the_class_stays(spark):
    rng = random.Random(12)
    a, b = prose(rng, 40), prose(rng, 40)
    smallest = min((a, b), key=lambda t: hashlib.sha256(" ".join(t.split()).encode()).hexdigest())
    for rows in ([(1, a), (1, b), (2, "x y z")], [(1, b), (1, a), (2, "x y z")]):
        kept = ngram_join.keep_one(documents(spark, rows))
        assert {(r.doc_id, r.text) for r in kept.collect()} == {(1, smallest), (2, "x y z")}


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(500, 500 + i) for i in range(50)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}


# -- 6: decontamination --------------------------------------------------------------------

def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *itertools.accumulate(range(1, len(b) + 1), lambda left, j, prev=row, x=x: max(left, prev[j], prev[j - 1] + (x == b[j - 1])), initial=0)][1:]
    return row[-1]


def test_common_subsequence():
    rng = random.Random(9)
    for _ in range(50):
        a = [rng.randint(0, 5) for _ in range(rng.randint(0, 30))]
        b = [rng.randint(-1, 5) for _ in range(rng.randint(0, 40))]
        assert decontaminate._common(decontaminate.Block._masks(np.array(a, dtype=np.int64)), len(a), b) == common(a, b)


def test_verbatim_and_paraphrased_passages_are_found(spark):
    rng = random.Random(10)
    items = [(i, prose(rng, rng.randint(15, 60)) + ". " + prose(rng, 6)) for i in range(60)]
    rows, leaks = [], set()
    for i in range(120):
        text = prose(rng, rng.randint(30, 400)).split()
        kind = i % 3
        if kind:
            item, passage = items[i % 60]
            words = passage.split()
            if kind == 2:  # a paraphrase: some words replaced, the answer kept
                for k in range(0, len(words) - 7, 6):
                    words[k] = "other" + str(k)
            at = rng.randint(0, len(text))
            text[at:at] = words
            leaks.add((i, item))
        rows.append((i, " ".join(text)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.search(documents(spark, rows), bench)
    assert {(r.doc_id, r.item_id) for r in out.collect()} == leaks
    clean = decontaminate.drop_contaminated(documents(spark, rows), bench)
    assert sorted(r.doc_id for r in clean.select("doc_id").collect()) == [i for i in range(120) if i % 3 == 0]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_of_the_candidate_search(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    bench = spark.read.parquet(f"/root/testdata/{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in r.text}
    got = {(r.doc_id, r.item_id) for r in decontaminate.search(docs, bench).collect()}
    assert len(want) and len(want & got) >= 0.99 * len(want)


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = {(r.doc_id, b.item_id) for r in docs.collect() for b in bench.collect() if b.text in r.text}
    assert want <= {(r.doc_id, r.item_id) for r in decontaminate.search(docs, bench).collect()}


def fitted_block(items, texts, scale=1):
    """A block fitted on ``texts`` as if each stood ``scale`` times in the table, without Spark."""
    block = decontaminate.Block(list(enumerate(items)))
    size = decontaminate.PASSAGE
    held = [np.unique(p[p >= 0]) for t in texts for p in [decontaminate._lookup(block.terms, decontaminate._words(t))]
            for k in range(0, len(p), size) for p in [p[k:k + size]]]
    frequency, sketch = np.zeros(len(block.terms)), np.zeros(block.test.shape)
    for terms in held:
        frequency[terms] += scale
        sketch[terms] += scale * block.test[terms].sum(axis=0)
    block.fit(frequency, sketch, scale * sum(-(-len(decontaminate._words(t)) // size) for t in texts))
    return block


def found_items(block, text):
    return {m[0] for m in block.matches(decontaminate._lookup(block.terms, decontaminate._words(text)))}


def own_words(rng, n):
    return [rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"u{rng.randint(0, 20_000)}" for _ in range(n)]


def test_full_blocks_keep_every_item():
    rng = random.Random(21)
    for _ in range(3):
        items = [" ".join(own_words(rng, 15 + i % 45)) for i in range(256)]
        rest = [own_words(rng, 60) for _ in items]
        texts = [" ".join([*words[:25], item, *words[25:]]) for words, item in zip(rest, items, strict=True)]
        block = fitted_block(items, texts)
        assert [i for i, t in enumerate(texts) if i not in found_items(block, t)] == []


@pytest.mark.parametrize("n", [400, 2000, 5000])
def test_long_items_are_found(n):
    rng = random.Random(22)
    items = [" ".join(f"u{k}" for k in rng.sample(range(20_000), size)) for size in (n, 33)]
    texts = [" ".join([*own_words(rng, 70), item, *own_words(rng, 70)]) for item in items]
    block = fitted_block(items, texts + [" ".join(own_words(rng, 5000)) for _ in range(20)])
    assert [found_items(block, t) for t in texts] == [{0}, {1}]


@pytest.mark.parametrize("scale", [1, 300, 30_000])
def test_paraphrases_are_found_in_tables_of_any_size(scale):
    rng = random.Random(23)
    items, texts = [], []
    for i in range(256):
        words = own_words(rng, 15 + i % 45)
        items.append(" ".join(words[:-6]) + ". " + " ".join(words[-6:]))
        gone = rng.sample(range(len(words) - 6), int(0.38 * len(words)))
        copy = [f"other{k}" if k in gone else w for k, w in enumerate(words)]
        texts.append(" ".join([*own_words(rng, rng.randint(0, 60)), *copy, *own_words(rng, 40)]))
    block = fitted_block(items, texts + [" ".join(own_words(rng, 5000)) for _ in range(20)], scale)
    assert [i for i, t in enumerate(texts) if i not in found_items(block, t)] == []


def test_pieces_that_the_space_keeps_are_searched_in_it():
    rng = random.Random(24)
    topics = [[f"t{k}w{j}" for j in range(12)] for k in range(6)]
    items = [" ".join(rng.sample(topics[k], 12)) for k in range(6)]
    texts = [" ".join([*own_words(rng, 40), *rng.sample(topics[i % 6], 12), *own_words(rng, 40)]) for i in range(60)]
    texts += [" ".join([*own_words(rng, 20), item, *own_words(rng, 20)]) for item in items]
    block = fitted_block(items, texts)
    assert len(block.latent) == 6

    def candidates(b, text):
        ids = decontaminate._lookup(b.terms, decontaminate._words(text))
        return {item for _, item in b.candidates(ids, np.array([0, len(ids)]))}

    assert all(k in candidates(block, texts[60 + k]) and k in found_items(block, texts[60 + k]) for k in range(6))
    # Words of a topic in another order are near in the space, without a common subsequence.
    assert all(i % 6 in candidates(block, texts[i]) for i in range(60))
    blind = decontaminate.Block(list(enumerate(items)))
    blind.fit(np.full(len(blind.terms), 10.0), np.zeros(blind.test.shape), 500)
    assert len(blind.latent) == 0  # without the sketch nothing is searched in the space


def test_common_words_must_stand_close_together():
    rng = random.Random(25)
    words = [f"v{k}" for k in range(30)]
    block = fitted_block([" ".join(words)], [" ".join(own_words(rng, 400))] * 3)
    near = " ".join(w for k, w in enumerate(words) for w in ([w, f"f{k}"] if k % 2 else [w]))
    far = " ".join(w for k, w in enumerate(words) for w in [w, *[f"f{k}_{j}" for j in range(5)]])
    assert found_items(block, near) == {0} and found_items(block, far) == set()


def test_each_region_is_checked_with_its_own_answer():
    words = [f"v{k}" for k in range(40)]
    item = " ".join(words[:32]) + ". " + " ".join(words[32:])
    without = words[:28] + [f"x{k}" for k in range(12)]                        # 0.7 of the item, not its answer
    answered = words[:18] + [f"y{k}" for k in range(14)] + words[32:]          # 0.65 with the whole answer
    gap = [f"z{k}" for k in range(300)]
    block = fitted_block([item], [" ".join(gap)] * 3)
    assert found_items(block, " ".join(without + gap)) == set()
    assert found_items(block, " ".join(answered + gap)) == found_items(block, " ".join(without + gap + answered)) == {0}


# -- 7: substring dedup --------------------------------------------------------------------

def removed(rows, window):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in rows:
        w = words_of(t)
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k:k + window])] < i for j in range(window)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("shard,stream", [(50_000, 400_000), (20, 30)])
def test_substring_dedup(spark, shard, stream):
    rng = random.Random(11)
    stock = [[rng.choice("abcdefg") for _ in range(40)] for _ in range(5)]
    rows = []
    for i in rng.sample(range(1000), 60):
        words = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 20))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(stock)
            a = rng.randrange(len(s))
            words += s[a:a + rng.randint(1, 30)] + [rng.choice("xyz")]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(2000, rows[0][1]), (2001, rows[1][1])]
    out = substring_dedup.dedup(documents(spark, rows), window=6, gram=3, shard_words=shard, stream_words=stream)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()} == removed(rows, 6)


def test_suffix_automaton():
    rng = random.Random(12)
    passages = [([rng.choice("ab") for _ in range(rng.randint(1, 25))], rng.randint(0, 9)) for _ in range(12)]
    automaton = SuffixAutomaton()
    for words, owner in passages:
        automaton.add(words, owner)
    automaton.finish()
    for least in (1, 3, 5):
        for owner in range(10):
            text = [rng.choice("abc" if owner % 2 else "ab") for _ in range(40)]
            gone = {k + j for k in range(len(text) - least + 1) for w, o in passages if o < owner
                    for a in range(len(w) - least + 1) if w[a:a + least] == text[k:k + least] for j in range(least)}
            spans = automaton.spans(text, owner, least)
            assert {i for a, b in spans for i in range(a, b)} == gone
            assert all(b < c for (_, b), (c, _) in itertools.pairwise(spans)) or not spans


# -- 8: classifier -------------------------------------------------------------------------

def test_held_out_accuracy_and_no_use_of_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    sample = quality_classifier.sample(docs, labels, "doc_id", "text", 500, 3000)
    other = labels.withColumn("quality", quality_classifier.F.when(
        quality_classifier.held_out(labels.doc_id), 1 - labels.quality).otherwise(labels.quality))
    assert quality_classifier.sample(docs, other, "doc_id", "text", 500, 3000) == sample
    scores = quality_classifier.score(docs, quality_classifier.fit(*sample))
    held = scores.join(labels, "doc_id").filter(quality_classifier.held_out(labels.doc_id)).collect()
    assert np.mean([(r.score >= 0.5) == r.quality for r in held]) >= 0.93
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) >= 0.9


# -- 9: WARC -------------------------------------------------------------------------------

def test_warc_records_are_rebuilt_exactly(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>é</p>" * 20), (2, "http://b/", "<p>é</p>" * 20), (3, "http://c/", "x\r\n\r\ny")],
                                  "page_id long, url string, html string")
    warc.write_archive(pages, f"{tmp_path}/w")
    assert spark.read.parquet(f"{tmp_path}/w/payloads").count() == 2
    made = {r.key: bytes(r.record) for r in warc.records(spark, f"{tmp_path}/w").collect()}
    for r in pages.collect():
        head, _, rest = made[r.page_id].partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and fields[b"WARC-Target-URI"] == r.url.encode()
        body = r.html.encode()
        assert fields[b"WARC-Payload-Digest"] == b"sha256:" + hashlib.sha256(body).hexdigest().encode()
        assert rest == (b"" if r.page_id == 2 else body) + b"\r\n\r\n"
        assert int(fields[b"Content-Length"]) == len(rest) - 4
    assert b"WARC-Refers-To: <urn:record:1>" in made[2]
    warc.export_files(spark, f"{tmp_path}/w", f"{tmp_path}/out")
    text = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))
    assert len(text) == sum(map(len, made.values())) and all(m in text for m in made.values())


# -- 10: URL filters -----------------------------------------------------------------------

def test_templates_are_generalised_and_rejected(spark):
    urls = [(i, f"http://shop.org/item/name{i}x/{1000 + i}") for i in range(40)] + [(100 + i, f"http://shop.org/spam/{2000 + i}.html") for i in range(40)]
    urls += [(200 + i, f"http://shop.org/junk/{3000 + i}.html") for i in range(40)] + [(300, "http://shop.org/other/7")]
    urls += [(400 + i, f"http://shop.org/{1200 + i}") for i in range(80)]
    labels = [(1000 + i, 1) for i in range(40)] + [(1200 + i, 1) for i in range(80)] + [(2000 + i, 0) for i in range(40)] + [(3000 + i, 0) for i in range(3)]
    out = url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(labels, "label_id long, good int"))
    by = {r.page_id: r for r in out.collect()}
    assert {by[i].template for i in range(40)} == {"/item/*/{n}"}
    assert {by[i].verdict for i in range(40)} == {"allow"} and {by[100 + i].verdict for i in range(40)} == {"block"}
    assert {by[200 + i].verdict for i in range(40)} == {"block"} and by[300].verdict == "allow"


def verdicts(spark, paths, bad):
    """path -> verdict, the label of each URL being bad if its path starts with ``bad``."""
    urls = [(i, f"http://site.org{path}/{i}", int(not path.startswith(bad))) for i, path in enumerate(paths)]
    out = url_filter.judge(spark.createDataFrame([u[:2] for u in urls], "page_id long, url string"),
                           spark.createDataFrame([(i, good) for i, _, good in urls], "label_id long, good int"))
    got = {}
    for r in out.collect():
        got.setdefault(paths[r.page_id], set()).add(r.verdict)
    return got


def test_frequent_children_keep_their_verdicts_at_any_count(spark):
    sections = [f"/section{'x' * (k % 7)}{chr(97 + k % 26)}{k}" for k in range(40)]
    want = {s: {"block" if s == sections[0] else "allow"} for s in sections}
    assert verdicts(spark, sections * 20, sections[0]) == want


def test_branches_below_the_third_level_are_judged(spark):
    deep = ["/a/b/c/good", "/a/b/c/spam", "/a/b/c/d/e/good", "/a/b/c/d/e/spam"]
    got = verdicts(spark, [d for d in deep for _ in range(30)] + ["/a/b/c/d/e/f/g/h"], ("/a/b/c/spam", "/a/b/c/d/e/spam"))
    assert got == {d: {"block" if d.endswith("spam") else "allow"} for d in deep} | {"/a/b/c/d/e/f/g/h": {"allow"}}


# -- pipeline ------------------------------------------------------------------------------

def test_pipeline_against_brute_force(spark, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def good(text):
        n, chars, symbols, dups, again = rule_counts(text)
        lines = [x for x in text.split("\n") if words_of(x)]
        stop = sum(w in quality_rules.STOP_WORDS for w in words_of(text))
        if n < 50 or 100 * again > 50 * n:
            return False
        shares = {"mean_word_chars": chars / n, "symbols_per_word": symbols / n, "exclamations_per_word": text.count("!") / n,
                  "stop_word_share": stop / n, "duplicate_line_share": dups / len(lines),
                  "bullet_line_share": sum(bool(re.match(r"[\x20\x09-\x0D]*[-*•]", x)) for x in lines) / len(lines),
                  "ellipsis_line_share": sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in lines) / len(lines)}
        return not any(shares[r.metric] < r.bound if r.op == "<" else shares[r.metric] > r.bound for r in quality_rules.RULES)

    kept = [(i, t) for i, t in docs if good(t)]
    classes = jaccard_classes(kept)
    kept = [(i, t) for i, t in kept if classes[i][0] == i]

    def words(text):
        return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))

    def leaked(text):
        w = words(text)
        for item in map(words, items):
            windows = (w[k:k + 2 * len(item)] for k in range(0, max(1, len(w) - len(item)), max(1, len(item) // 2)))
            if any(common(item, x) >= 0.8 * len(item) for x in windows):
                return True
        return False

    kept = [(i, t) for i, t in kept if not leaked(t)]

    def redacted(text):
        out, at = "", 0
        for a, _, b in base_spans(text):
            if a >= at:
                out, at = out + text[at:a] + "[SECRET]", b
            at = max(at, b)
        return out + text[at:]

    want = {i: library.encode(redacted(t)) for i, t in kept}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == sorted(want) and got == want
