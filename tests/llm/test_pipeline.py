"""The pipeline against the operators' brute-force versions, stage by stage."""

import struct

from tokenizers import Tokenizer

import corpus_pipeline
from passagemill.llm import langid, queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_each_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], SF).persist())
    start, spoken, single, clean, masked, coded = map(rows, kept)
    assert all(df.columns == columns for df in kept[:-1]) and kept[-1].columns[: len(columns)] == columns

    tools = langid.Compressors(langid.fit(docs))
    assert set(spoken) == {i for i, r in start.items() if tools.predict(r.text)[2]}
    assert len(spoken) > 0.98 * len(start)

    groups = brute.near_duplicates([(i, r.text) for i, r in spoken.items()])
    assert set(single) == {i for i, (_, _, first) in groups.items() if first}

    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    leaks = brute.leaks([(i, r.text) for i, r in single.items()], items)
    assert set(clean) == {i for i, (_, hit, _) in leaks.items() if not hit} and len(clean) < len(single)

    assert set(masked) == set(clean)
    for i, r in masked.items():
        if not brute.secrets(clean[i].text):
            assert r == clean[i]
        else:
            assert not brute.secrets(r.text) and "[SECRET]" in r.text and r.n_chars == len(r.text)

    library = Tokenizer.from_file(queries.BYTE_BPE)
    assert set(coded) == set(masked)
    for i, r in coded.items():
        assert list(struct.unpack(f"<{r.n_tokens}I", r.ids)) == library.encode(r.text, add_special_tokens=False).ids
        assert r.round_trip

    whole = rows(corpus_pipeline.run(spark, SF))
    assert whole == coded


def test_nulls_repeats_and_clashing_columns(spark):
    prose = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en' and length(text) > 300").limit(3).collect()
    made = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "k") for r in prose]
    made += [made[0], (None, made[1][1], "en", None, None, None), (990, None, None, None, None, "k"), (991, "", "en", "s", 0, "k")]
    docs = spark.createDataFrame(
        made, "doc_id long, text string, lang string, source string, n_chars long, document string"
    ).selectExpr("*", "document as kept", "document as row", "document as secrets", "document as hit_words")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        docs = stage(spark, docs, SF).persist()
        if number == 2:  # the repeated row is one, the row without id stays
            assert sorted(str(r.doc_id) for r in docs.collect()) == sorted(["None", *(str(m[0]) for m in made[:3])])
    assert docs.count() <= 4 and "kept" in docs.columns


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_another_text_under_a_kept_id_stays(spark):
    """Rows that repeat id and text are one, in any order; a different text is no copy."""
    a, b = ("one text of its own " * 9, "and another one that is not alike " * 9)
    made = [(5, a), (5, a), (5, b), (6, a)]
    for rows_ in (made, made[::-1]):
        docs = spark.createDataFrame(rows_, "doc_id long, text string")
        got = corpus_pipeline.one_of_each(spark, docs, SF)
        assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted({(5, a), (5, b)})
