"""Operators against brute force on a small fixture with all the odd cases, and on empty tables."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from brute import equal_texts, jaccard_components, jaccard_links, repeated_bytes, repeated_words, sha

from careerloom.llm import bpe, exact_dedup, jaccard, language, mixing, nn_descent, pseudonyms, quality, recompression, suffix_dedup
from careerloom.llm.components import connected
from careerloom.llm.queries import vocabulary_path


@pytest.fixture(scope="module")
def odd_docs():
    """(doc_id, text): exact and near copies, shared passages, runs, null, empty, blank and long texts, ties."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(900)] + ["Ünï", "ñ", "日本語", "x."]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(70), text(160)
    docs = [None, "", " \t\n", "one", "one two three", "One  TWO\nthree", "la " * 120, "a b " * 90, "z" * 900, "z" * 401]
    docs += [base, base, base.replace(" ", "\n"), base + "  "]
    for _ in range(12):
        own = base.split(" ")
        for _ in range(rng.randint(1, 6)):
            own[rng.randrange(len(own))] = rng.choice(words)
        docs.append(" ".join(own))
    docs += [text(40) + " " + passage + " " + text(rng.randint(0, 30)) for _ in range(8)]
    docs += [text(rng.randint(1, 250)) for _ in range(20)] + [text(6000), passage, passage + " " + passage]
    return list(enumerate(docs))


@pytest.fixture(scope="module")
def odd_frame(spark, odd_docs):
    """The same with columns whose names clash with the operators' own."""
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", 1, "x", 2.0, True) for i, t in odd_docs]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, key string, size double, tokens boolean").repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")


def test_recompression_equals_brute_force(odd_frame, odd_docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.remove_repeats(odd_frame).collect()}
    assert got == repeated_words(odd_docs)


@pytest.mark.parametrize("k", [14, 17])
def test_recompression_other_windows(odd_frame, odd_docs, k):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.remove_repeats(odd_frame, k).collect()}
    assert got == repeated_words(odd_docs, k)


@pytest.mark.parametrize("most_kinds", [suffix_dedup.MOST_KINDS, 1])
def test_suffix_dedup_equals_brute_force(odd_frame, odd_docs, most_kinds):
    rows = suffix_dedup.remove_repeats(odd_frame, most_kinds=most_kinds).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == repeated_bytes(odd_docs)


@pytest.fixture(scope="module")
def shared_ids(spark, odd_docs):
    """Rows with null and repeated ids and unlike texts, as (id, text), and the same in row order under ids of their own."""
    texts = [t for _, t in odd_docs if t]
    rng = random.Random(11)
    word = lambda: f"v{rng.randrange(700)}"
    long, short = " ".join(word() for _ in range(300)), " ".join(word() for _ in range(60))
    tail = " ".join(word() for _ in range(40))
    rows = [(None, long), (None, short + " " + tail), (7, tail + " end"), (7, long[:600] + " x"), (8, short), (8, texts[14]), (9, texts[15])]
    rows += [(20 + i // 3, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    order = [(r.doc_id, r.text) for r in sorted(frame.selectExpr("*", "xxhash64(text) AS h").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))]
    return frame.repartition(2), list(dict.fromkeys(order))


def test_recompression_of_rows_that_share_ids(shared_ids):
    frame, order = shared_ids
    want = repeated_words([(i, t) for i, (_, t) in enumerate(order)])
    got = {(r.doc_id, *(r.n_words, r.n_removed, r.kept_sha256)) for r in recompression.remove_repeats(frame).collect()}
    assert got == {(order[i][0], *w) for i, w in want.items()}


@pytest.mark.parametrize("most_kinds", [suffix_dedup.MOST_KINDS, 1])
def test_suffix_dedup_of_rows_that_share_ids(spark, shared_ids, most_kinds):
    _, order = shared_ids
    frame = spark.createDataFrame(order, "doc_id long, text string").repartition(2)
    want = repeated_bytes([(i, t) for i, (_, t) in enumerate(order)])
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame, most_kinds=most_kinds).collect()}
    assert got == {(order[i][0], *w) for i, w in want.items()}


def test_suffix_order_is_lexicographic():
    rng = np.random.default_rng(2)
    flat = rng.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(300)
    order, same = suffix_dedup.suffix_order(flat, starts, 20)
    keys = [flat[s : s + 20].tobytes() for s in starts[order]]
    assert keys == sorted(keys) and same.tolist() == [False] + [a == b for a, b in zip(keys, keys[1:])]


def test_jaccard_components(odd_frame, odd_docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(odd_frame).collect()}
    assert got == jaccard_components(odd_docs)
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(odd_frame, 5, Fraction(80, 100)).collect()}
    assert near == jaccard_components(odd_docs, 5, 80)


def test_jaccard_blocks_lose_no_link(spark, odd_frame, odd_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    got = {r.doc_id: r.component_id for r in jaccard.components(odd_frame).collect()}
    assert got == {i: c for i, (_, c) in jaccard_components(odd_docs).items()}


@pytest.mark.parametrize("block", [2, 400])
def test_jaccard_link_counts(spark, odd_frame, odd_docs, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    near = [(5000 + n, " ".join([a, *["more"] * (n % 7), *[f"t{n}"] * (n % 3)])) for n in range(40)] + [(5100 + n, b) for n in range(9)]
    docs = odd_docs + near
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = jaccard.components(frame, counted=True).collect()
    assert sorted((r.doc_id, r.n_links) for r in got) == sorted(jaccard_links(docs))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_components(docs)


def test_connected_path_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.id: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_exact_dedup(odd_frame, odd_docs):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(odd_frame).collect()}
    assert got == equal_texts(odd_docs)


def test_exact_dedup_keeps_one_row(spark):
    rows = [(None, "a b"), (None, "a b"), (5, "a b"), (5, "a b"), (6, "ab"), (None, "z"), (None, " z"), (None, " z"), (3, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs).collect()), key=repr)
    assert got == sorted([(3, 3, 1, True), (5, 5, 5, True), (5, 5, 5, False), (6, 5, 5, False), *[(None, 5, 5, False)] * 2,
                          (None, None, 3, True), *[(None, None, 3, False)] * 2], key=repr)


def test_exact_dedup_with_names_that_clash(spark, odd_frame, odd_docs, monkeypatch):
    short = lambda docs: real(docs).withColumn("recipe", exact_dedup.F.transform("recipe", lambda c: c.withField("name", exact_dedup.F.lit(1).cast("long"))))
    real = exact_dedup.recipes
    monkeypatch.setattr(exact_dedup, "recipes", short)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(odd_frame).collect()}
    assert got == equal_texts(odd_docs)


def test_bpe_equals_the_library(odd_frame, odd_docs):
    from tokenizers import Tokenizer

    more = ["it's I'LL <|endoftext|>ab<|startoftext|>", "ΑΣ Σ É ½ ²", "aaaa" * 300, "#$%!!"]
    tok = Tokenizer.from_file(vocabulary_path())
    vocabulary = bpe.Vocabulary.load(vocabulary_path())
    for t in more:
        ids, names = next(bpe.encode_texts([t], vocabulary))
        want = tok.encode(t, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and names == tok.decode(want, skip_special_tokens=False) == bpe.decode(want, vocabulary)
    for r in bpe.encoded(odd_frame, vocabulary_path(), keep_ids=True).collect():
        want = tok.encode(dict(odd_docs)[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want) and r.ids_sha256 == sha(" ".join(map(str, want)).encode())
        assert r.decoded_sha256 == sha(tok.decode(want, skip_special_tokens=False).encode())


def test_bpe_of_many_special_tokens():
    from tokenizers import Tokenizer

    text = "<|endoftext|>" * 3000 + "It's<|startoftext|>a" * 2 + "<|endoftext|"
    ids, names = next(bpe.encode_texts([text], bpe.Vocabulary.load(vocabulary_path())))
    tok = Tokenizer.from_file(vocabulary_path())
    want = tok.encode(text, add_special_tokens=False).ids
    assert ids == " ".join(map(str, want)) and names == tok.decode(want, skip_special_tokens=False)


def test_mix_of_rows_that_share_ids_and_sizes(spark):
    rows = [(None if i % 2 else 7, f"a{i} b c d e", "s", 1) for i in range(60)] + [(9, "x y z", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int").withColumn("row", exact_dedup.F.col("text"))
    taken = [sorted((r.row, r.taken) for r in mixing.mix(docs.repartition(n), also=("row",)).collect()) for n in (1, 5, 9)]
    assert taken[0] == taken[1] == taken[2] and len({t for _, t in taken[0]}) > 1
    texts = [sorted(r.text for r in mixing.mixed_documents(docs.repartition(n)).collect()) for n in (2, 7)]
    assert texts[0] == texts[1]


def test_mix_meets_its_targets(odd_frame, odd_docs):
    rows = mixing.mix(odd_frame).collect()
    own, taken, target = Counter(), Counter(), {}
    for r in rows:
        own[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.size == len((dict(odd_docs)[r.doc_id] or "").split())
    want, open_to = 1.5 * sum(own.values()), {s: w for s, w in zip(sorted(own, key=lambda s: (s is None, s or "")), (5, 2, 1, 5))}
    full: dict = {}
    while True:
        level = (want - sum(full.values())) / sum(open_to.values())
        over = [s for s in open_to if level * open_to[s] > 2 * own[s] + 1e-9]
        if not over:
            break
        for s in over:
            full[s] = 2 * own[s]
            del open_to[s]
    expect = full | {s: level * w for s, w in open_to.items()}
    assert all(abs(target[s] - expect[s]) < 1e-6 and abs(taken[s] - expect[s]) <= 0.5 for s in own)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd_frame.repartition(7)).collect()))


def test_mixed_documents_hold_the_words_taken(odd_frame):
    taken = {r.doc_id: r.taken for r in mixing.mix(odd_frame).collect()}
    words = defaultdict(int)
    out = mixing.mixed_documents(odd_frame)
    assert out.columns == odd_frame.columns
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
    assert {i: n for i, n in taken.items() if n} == dict(words)


def test_pseudonyms(spark):
    rows = [
        (1, "card 4111 1111 1111 1111, +1 (521) 555-2373, a.B3@x.example.com, 10.0.0.1, 2020-02-29 31/12/1999 123-45-6789"),
        (2, None), (3, ""), (4, "4111111111111111 2020-02-29 4111111111111112 30.02.2001 999.1.1.1 000-12-3456"), (4, "10.0.0.1"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kinds", "2 AS key")
    got = [(r.doc_id, r.n_found, r.text) for r in pseudonyms.pseudonymised(docs, "k").collect()]
    assert got[1:3] == [(2, 0, None), (3, 0, "")]
    first, fourth = got[0][2], got[3][2]
    assert got[0][1] == 7 and got[3][1] == 2
    shape = lambda t: re.sub("[0-9]", "0", t)
    assert shape(re.sub(r"\S+@", "@", re.sub(r"[0-9.]{7,}(?=, 2)", "ip", first))) == shape(re.sub(r"\S+@", "@", re.sub(r"[0-9.]{7,}(?=, 2)", "ip", rows[0][1])))
    card = re.search(r"card ([0-9 ]{19})", first)[1].replace(" ", "")
    assert fourth.startswith(card) and card != "4111111111111111" and fourth.endswith("4111111111111112 30.02.2001 999.1.1.1 000-12-3456")
    digits = list(map(int, card[::-1]))
    assert (sum(digits[::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[1::2])) % 10 == 0
    assert got[4][2] in first  # linked across documents
    assert pseudonyms.pseudonymised(docs, "other").first().text != first


def test_pseudonyms_of_cards_beside_other_numbers(spark):
    card, amex = "4111 1111 1111 1111", "3782 822463 10005"
    cases = [  # text, values found
        (f"card {card} 12/27", 1), ("4111111111111111 123 main", 1), ("paid 4111111111111111 20 EUR", 1), (f"12 {card}", 1),
        (f"1234 5678 9012 {card}", 1), (f"{card} {card}", 2), (f"{amex}-7 {card} 99", 2), (f"{card} 555-234-4567", 2),
        (f"{card} 31/12/1999", 2), (f"{card} 10.0.0.1", 2), ("4111 1111 1111 1112 12", 0), ("7" * 5000 + " " + "1 " * 5, 0),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymised(docs, "k").collect()}
    one = pseudonyms.pseudonymised(spark.createDataFrame([(0, card)], "doc_id long, text string"), "k").first().text
    for i, (text, n) in enumerate(cases):
        assert got[i].n_found == n == len(got[i].kinds) and re.sub("[0-9]+", "", got[i].text) == re.sub("[0-9]+", "", text), text
        assert "4111" not in got[i].text and "10005" not in got[i].text if n else got[i].text == text
        if n and card in text:
            assert got[i].text.count(one) == text.count(card)  # linked with the card alone


def test_pseudonyms_of_dates_in_all_orders(spark):
    same = ["1990-03-25", "1990-3-25", "03/25/1990", "3/25/1990", "25/03/1990", "25.3.1990", "25.03.1990", "03.25.1990"]
    both = ["1990-03-05", "3/5/1990", "03/05/1990", "5.3.1990", "05.03.1990"]  # slashes: month first
    bad = ["13/32/1990", "0/5/1990", "31.2.1990", "1990-13-1", "1/2/1790"]
    docs = spark.createDataFrame(list(enumerate(same + both + bad)), "doc_id int, text string")
    got = [(r.n_found, r.text) for r in sorted(pseudonyms.pseudonymised(docs, "k").collect(), key=lambda r: r.doc_id)]
    assert got[13:] == [(0, t) for t in bad] and all(n == 1 for n, _ in got[:13])
    for texts, made in ((same, [t for _, t in got[:8]]), (both, [t for _, t in got[8:13]])):
        y, m, d = map(int, made[0].split("-"))
        plain = lambda *p: [str(x) for x in p]
        two = lambda *p: [f"{x:02}" for x in p]
        for text, out in zip(texts, made):
            sep = re.search("[-./]", text)[0]
            parts, shown = text.split(sep), out.split(sep)
            order = (0, 1, 2) if sep == "-" else (1, 2, 0) if (sep == "/" and texts is both) or parts[1] == "25" else (2, 1, 0)
            assert [int(x) for x in shown] == ([y, m, d] if order == (0, 1, 2) else [m, d, y] if order == (1, 2, 0) else [d, m, y]), (text, out)
            assert all(x in (two(int(x)) if len(p) == 2 else plain(int(x))) for p, x in zip(parts, shown) if len(p) < 4), (text, out)
        assert out != text


def test_feistel_is_a_permutation(spark):
    F = pseudonyms.F
    out = spark.range(35).select(pseudonyms.feistel(F.col("id"), F.lit(5), F.lit(7), "k", "t").alias("v")).collect()
    assert sorted(r.v for r in out) == list(range(35))


def test_languages_are_learned_and_mixed(spark):
    rng = random.Random(1)
    kinds = {"aa": ["taka", "mako", "tomak", "kat"], "bb": ["shelu", "wesh", "lush", "ehle"]}
    text = lambda lang, n: " ".join(rng.choice(kinds[lang]) for _ in range(n))
    rows = [(i, text(lang, 30), lang) for i in range(80) for lang in [("aa", "bb")[i % 2]]]
    rows += [(100, None, "aa"), (101, "12 34", "aa"), (102, "", None), (103, text("aa", 60) + " " + text("bb", 40), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.predicted_languages(docs).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:80])
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (100, 101, 102))
    assert got[103].languages == ["aa", "bb"] and 0.5 < got[103].score < 0.75


def test_four_languages_in_one_text(spark):
    rng = random.Random(4)
    kinds = {"aa": ["taka", "mako", "tomak"], "bb": ["shelu", "wesh", "lushe"], "cc": ["zinoz", "ozin", "nizzo"], "dd": ["pyrry", "gryp", "ryppg"]}
    text = lambda lang, n: " ".join(rng.choice(kinds[lang]) for _ in range(n))
    rows = [(i, text(lang, 30), lang) for i in range(160) for lang in [sorted(kinds)[i % 4]]]
    rows += [(500, " ".join(text(lang, 80) for lang in kinds), None), (501, text("cc", 50) + " " + text("dd", 50), None)]
    got = {r.doc_id: r for r in language.predicted_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sorted(got[500].languages) == sorted(kinds) and all(abs(s - 0.25) < 0.08 for s in got[500].shares)
    assert sorted(got[501].languages) == ["cc", "dd"]


def test_quality_rules(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(240):
        good = i % 4 != 0
        words = [rng.choice("tree river stone cloud maple".split()) + str(rng.randrange(50)) for _ in range(60)]
        rows.append((i, " ".join(words if good else [w + "###" for w in words])))
        labels.append((i, int(good), 0))
    rows += [(1000, None), (1001, "")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(0, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(docs, known).collect()}
    assert len(got) == 242 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].predicted == q for i, q, _ in labels)
    alike = quality.quality_scores(docs, known.where("quality = 1"))
    assert {r.predicted for r in alike.collect()} == {1}


def test_neighbours_are_found(spark):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((12, 16))
    x = centers[rng.integers(0, 12, 600)] + 0.4 * rng.standard_normal((600, 16))
    x[300:330] = x[300]
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)] + [(900, None, "a"), (901, [0.0] * 16, "a"), (902, [1.0, float("nan")] * 8, "a"), (903, [], "a")]
    got = nn_descent.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string"), every=100).collect()
    hits = 0
    for q in range(0, 600, 100):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = sorted(range(600), key=lambda i: (d[i], i))[:10]
        hits += len(set(want) & {r.vec_id for r in mine})
        assert [r.rank for r in mine] == list(range(1, 11)) and all(abs(r.score - d[r.vec_id]) < 1e-9 for r in mine)
        if q == 300:
            assert [r.vec_id for r in mine] == want
    assert hits >= 0.9 * 60


def test_few_vectors_under_many_partitions(spark):
    rows = [(i * 50, [float(i), 1.0, float(i * i % 7)]) for i in range(15)] + [(1000 + i, [3.0, 1.0, 2.0]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = nn_descent.neighbours(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for query, q in [(i, v) for i, v in rows if i % 100 == 0]:
        near = sorted((float(np.linalg.norm(np.subtract(q, v))), i) for i, v in rows if i != query)[:10]
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == query] == [i for _, i in near]


def test_fewer_candidates_than_wanted(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [4.0, 6.0]), (2, [4.0, 7.0]), (3, [1.0])]
    got = nn_descent.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 1, 0.0), (0, 2, 2, 5.0)]


def test_jaccard_of_rows_that_share_ids(spark):
    a, b, other = (" ".join(f"{c}{i}" for i in range(100)) for c in "abc")
    rows = [(None, a), (3, a + " more"), (7, b), (7, other), (9, b + " more"), (None, None), (None, "alone"), (8, None)]
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, 97, 3), (3, 98, 3), (7, 97, 7), (7, 97, 7), (9, 98, 7), (None, 0, None), (None, 1, None), (8, 0, 8)]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), counted=True).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_links) for r in got))) == sorted(map(repr, jaccard_links(rows)))


def test_empty_tables(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<double>")
    made = [
        recompression.remove_repeats(no_docs), suffix_dedup.remove_repeats(no_docs), jaccard.components(no_docs, counted=True), exact_dedup.exact_duplicates(no_docs),
        bpe.encoded(no_docs, vocabulary_path()), mixing.mix(no_docs), mixing.mixed_documents(no_docs), language.predicted_languages(no_docs),
        quality.quality_scores(no_docs, labels), pseudonyms.pseudonymised(no_docs, "k"), nn_descent.neighbours(vectors),
    ]
    assert [df.count() for df in made] == [0] * len(made)


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b  c d e")], "doc_id long, text string")
    assert [r.component_id for r in jaccard.components(docs).collect()] == [1, 1, 1]
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs).collect()) == [(1, 2, 3, False)] * 2 + [(2, 2, 3, True)]
    assert recompression.remove_repeats(docs).count() == suffix_dedup.remove_repeats(docs).count() == 3


def test_held_out_languages_and_labels(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    docs, labels = read("documents"), read("labels")
    known = docs.where("lang is not null").select("doc_id", "lang")
    unseen = language.predicted_languages(docs).where("held_out and lang_pred <> 'und'").join(known, "doc_id").collect()
    assert len(unseen) > 150 and sum(r.lang == r.lang_pred for r in unseen) >= 0.98 * len(unseen)
    scored = quality.quality_scores(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert len(scored) > 60 and sum(r.quality == r.predicted for r in scored) >= 0.95 * len(scored)
