"""The pipeline's stages against plain answers on a small input."""

from __future__ import annotations

import random

from brute import equal_texts, jaccard_components

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    text = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(n))
    base = text(90)
    docs = [(i, text(60) if i % 5 else " ".join(w + "$$$" for w in text(60).split()), "en", f"s{i % 3}", 1) for i in range(150)]
    docs += [(200, base, "en", "s0", 1), (201, base + "\n", "en", "s1", 1), (202, base + " tail", "en", "s2", 1), (203, None, "en", None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, tables = now.columns, [now]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        tables.append(spark.read.parquet(f"{tmp_path}/{n}"))
    assert all(t.columns == columns for t in tables[:-1])
    listed = [[(r.doc_id, r.text) for r in t.collect()] for t in tables[:-1]]
    assert {i for i, _ in listed[1]} >= {i for i in range(150) if i % 5} | {200, 201, 202}
    assert not {i for i, _ in listed[1]} & {i for i in range(150) if i % 5 == 0}
    assert {i for i, _ in listed[2]} == {i for i, (_, _, kept, _) in equal_texts(listed[1]).items() if kept}
    assert {i for i, _ in listed[3]} == {i for i, (_, c) in jaccard_components(listed[2], 5, 80).items() if c == i}
    sizes = {i: len((t or "").split()) for i, t in listed[3]}
    mixed = sum(len(t.split()) for _, t in listed[4])
    assert abs(mixed - 1.5 * sum(sizes.values())) <= 2
    assert tables[5].count() == len(listed[4])
    assert spark.createDataFrame([], "a int").count() == 0 and corpus_pipeline.run(spark, str(tmp_path)).count() == len(listed[4])


def test_rows_with_null_repeated_and_shared_ids(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(n))
    spoiled = lambda t: " ".join(w + "$$$" for w in t.split())
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    frame = lambda rows: spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], schema).repartition(2)
    listed = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    learn = [(i, text(60) if i % 5 else spoiled(text(60)), "s0") for i in range(150)]
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    a, b, c, d = (text(90) for _ in range(4))
    odd = [(None, a, "s0"), (None, b, "s0"), (None, spoiled(c), "s0"), (300, d, "s0"), (300, spoiled(d), "s0"), (300, d, "s0")]
    good = listed(corpus_pipeline.quality_stage(spark, frame(learn + odd), str(tmp_path)))
    assert [x for x in good if x[0] is None or x[0] >= 150] == sorted([(None, a), (None, b), (300, d), (300, d)], key=str)

    rows = [(None, a), (None, a), (1, b), (1, b), (1, c), (2, c + " "), (3, d), (3, d.replace(" ", "\n")), (None, None)]
    once = corpus_pipeline.exact_stage(spark, frame([(*r, "s0") for r in rows]), str(tmp_path))
    got = listed(once)
    assert len(got) == 5 and [x for x in got if x[0] != 3] == sorted([(None, None), (None, a), (1, b), (2, c + " ")], key=str)

    rows = [(None, a), (5, a + " tail"), (6, b), (6, b + " tail"), (6, d), (4, d + " tail"), (None, c), (None, c + " tail")]
    near = listed(corpus_pipeline.near_stage(spark, frame([(*r, "s0") for r in rows]), str(tmp_path)))
    assert len(near) == 4 and {(4, d + " tail"), (5, a + " tail")} < set(near)
    assert sum(i == 6 for i, _ in near) == sum(i is None for i, _ in near) == 1

    rows = [(7, a, "s0")] * 5 + [(None, b, "s0"), (8, c, "s1"), (8, d, "s1"), (8, text(90), "s0")]
    docs = frame(rows)
    mixed = corpus_pipeline.mixing_stage(spark, docs, str(tmp_path)).collect()
    want = sum(r.taken for r in corpus_pipeline.mixing.mix(docs).collect())
    assert sum(len(r.text.split()) for r in mixed) == want > 0 and any(r.doc_id is None for r in mixed)
