"""The pipeline on planted cases: what must go goes, what is clean stays."""

import random

import pytest

import corpus_pipeline

LETTERS = "bcdfghklmnprst"


def word(rng):
    return "".join(rng.choice(LETTERS) + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))


def text(rng, lines=6, n=25):
    return "\n".join(" ".join(word(rng) for _ in range(n)) + "." for _ in range(lines))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(12)
    folder = tmp_path_factory.mktemp("sf")
    passage, item = " ".join(word(rng) for _ in range(60)), " ".join(word(rng) for _ in range(30))
    rows = [(i, text(rng)) for i in range(400)]
    rows += [(500 + i, rows[i][1]) for i in range(10)]  # exact copies
    near = rows[20][1].split(" ")
    near[40] = "changed"
    rows += [(520, " ".join(near))]
    rows += [(600 + i, text(rng) + "\n" + item) for i in range(5)]  # benchmark text
    rows += [(700 + i, text(rng) + "\n" + passage + "\n" + text(rng, 2)) for i in range(5)]  # a passage that recurs
    rows += [(800 + i, " ".join(word(rng) + "%%%" for _ in range(120))) for i in range(12)]  # junk
    rows += [(900, "too short"), (901, None), (902, "")]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), dict(rows), passage


def test_stages(spark, planted):
    folder, rows, passage = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, folder), "stage")
        assert docs.columns == columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
    quality, lines, near, clean = kept
    assert not set(quality) & {900, 901, 902, *range(800, 812)} and set(range(400)) <= set(quality)
    assert all(passage not in lines[700 + i] for i in range(5)) and all(lines[i] == rows[i] for i in range(400))
    assert set(lines) - set(near) == {520, *range(500, 510)}
    assert set(near) - set(clean) <= set(range(600, 605)) and all(rows[600 + i].rsplit("\n", 1)[1] not in clean.get(600 + i, "") for i in range(5))
    assert set(range(400)) <= set(clean)


def test_run_packs_what_is_left(spark, planted):
    got = corpus_pipeline.run(spark, planted[0])
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    assert set(range(400)) <= ids and not ids & {*range(500, 521), *range(800, 812), 900, 901, 902}
    assert got.agg({"length": "sum"}).first()[0] > 0


def test_rows_are_judged_each_by_its_own_text(spark, tmp_path):
    rng = random.Random(13)
    item = " ".join(word(rng) for _ in range(30))
    clean = [text(rng) for _ in range(8)]
    leak = text(rng) + "\n" + item
    rows = [(1, clean[0]), (None, clean[0]), (None, clean[1]), (None, clean[1]), (None, "too short"), (None, leak), (2, leak.replace("\n", " ")), (2, clean[2])]
    rows += [(3, "short as well"), (3, clean[3]), (3, clean[4]), (4, clean[5]), (4, clean[5]), (5, clean[6]), (None, clean[7])]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, str(tmp_path)), "stage")
    left = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    assert left == sorted([(1, clean[0]), (None, clean[1]), (2, clean[2]), (3, clean[3]), (3, clean[4]), (4, clean[5]), (5, clean[6]), (None, clean[7])], key=str)


def test_extra_columns_of_any_name(spark, tmp_path):
    """Names that the stages use themselves come through unchanged, from files and from other rows."""
    rng = random.Random(14)
    texts = [text(rng) for _ in range(6)]
    spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = ["_file", "_row", "_no", "_given", "given", "file", "row", "no", "id", "key", "group", "dropped", "emptied", "n_lines", "n_dropped", "component_id", "kept", "n_shingles", "distance", "cleaned", "a.b", "a`c", "contaminated", "none"]
    columns = ["doc_id", "text", "lang", "source", "n_chars", *extra]
    rows = [(i, t, "en", "src", len(t), *[f"{c}{i}" for c in extra]) for i, t in enumerate([*texts, texts[0]])]
    made = spark.createDataFrame(rows, ", ".join("`" + c.replace("`", "``") + "` " + {"doc_id": "long", "n_chars": "int"}.get(c, "string") for c in columns))
    made.repartition(2).write.parquet(f"{tmp_path}/docs")
    numbered = corpus_pipeline.keyed(made)
    assert sorted(tuple(r) for r in corpus_pipeline.given(numbered, made).collect()) == rows and numbered.select("doc_id").distinct().count() == 7
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, str(tmp_path)), "stage")
    assert sorted(tuple(r) for r in docs.collect()) == rows[:6] and docs.columns == columns


def test_empty_tables_nulls_and_very_long_texts(spark, tmp_path):
    rng = random.Random(15)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    long_text = text(rng, lines=700, n=25)
    for rows, left in (([], 0), ([(None, None, None, None, None)] * 3 + [(1, long_text, None, None, 5), (None, long_text, None, "s", None), (2, "", "en", None, 0)], 1)):
        docs = spark.createDataFrame(rows, kind)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.saved(stage(spark, docs, str(tmp_path)), "stage")
        assert [(r.doc_id, r.text) for r in docs.collect()] == [(1, long_text)][:left]
        assert corpus_pipeline.packing(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == left


def test_small_groups_of_outliers_go(spark):
    """Few rows of a source or language that all lie far out leave in the quality stage."""
    rng = random.Random(15)
    rows = [(i, text(rng), "en", f"s{i % 2}") for i in range(200)]
    odd = [(900 + i, " ".join(word(rng) + "%%%" for _ in range(80)), lang, source) for i, (lang, source) in enumerate([("en", "odd"), ("xx", "own"), (None, None)])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, "").select("doc_id").collect()}
    assert not kept & {900, 901, 902} and len(kept) >= 198
