import json

import pytest
from pyspark.sql import functions as F

from clausewright import providers
from clausewright.operators import services as V
from clausewright.plans.answer import ask
from clausewright.plans.ingest import ingest
from clausewright.sources import exports, files, settings
from clausewright.streaming import incremental

PROFILE = {"skip_sections": ["GLOSSARY"], "domain_tags": ["privacy"], "requirement_types": ["policy"]}


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\nnot json\n{"a": 2}\n[1]\n')
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField("a", LongType())])
    good, bad = files.read_jsonl_tolerant(spark, str(p), schema)
    assert sorted(x.a for x in good.collect()) == [1, 2] and bad.count() == 2
    assert files.count_lines(spark, str(p)) == 4 and files.count_lines(spark, str(tmp_path / "none")) == 0
    assert files.read_jsonl_or_empty(spark, str(tmp_path / "none"), schema).count() == 0
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(p), schema).collect()


def test_publish(spark, tmp_path):
    root = str(tmp_path / "t")
    files.publish(spark.range(3), root, "v1")
    files.publish(spark.range(5), root, "v2")
    assert files.read_current(spark, root).count() == 5
    with pytest.raises(Exception):
        files.publish(spark.range(9), root, "v2")
    assert files.read_current(spark, root).count() == 5


def test_settings_and_profiles(tmp_path):
    p = str(tmp_path / "s.json")
    assert settings.load(p, {"CLAUSEWRIGHT_TOP_K": "x", "CLAUSEWRIGHT_MIN_SCORE": "0.5"}).min_score == 0.5
    assert settings.update(p, {"top_k": 7}).top_k == 7 and settings.load(p, {}).top_k == 7
    with pytest.raises(ValueError):
        settings.update(p, {"nope": 1})
    full = {"name": "x", "description": "", "obligation_verbs": ["a"], "skip_sections": ["b"], "domain_tags": ["c"], "requirement_types": ["d"]}
    (tmp_path / "x.json").write_text(json.dumps(full))
    assert settings.load_profile("x", str(tmp_path))["name"] == "x"
    (tmp_path / "y.json").write_text(json.dumps(full))
    for bad in ("y", "../x", "none"):
        with pytest.raises(ValueError):
            settings.load_profile(bad, str(tmp_path))


def test_exports(spark):
    rows = [("R1", "=SUM(1)", "1.2", None, ["A", "B"], ["privacy"], "policy", 0.9, 1, 2, "x.pdf", "cybersecurity")]
    df = spark.createDataFrame(rows, "requirement_id string, source_quote string, source_ref string, description string, section_title_path array<string>, domain_tags array<string>, requirement_type string, confidence double, page_start int, page_end int, source_pdf string, domain_profile string")
    items = V.checklist(df, "cybersecurity")
    text = exports.to_csv(items)
    assert text.count("\r\n") == 2 and "'=SUM(1)" in text and "A > B" in text
    assert json.loads(exports.to_json(items, {"doc": "x"}))["items"][0]["pages"] == [1, 2]
    assert "Confidence: 0.90" in exports.to_markdown(items, "T")


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("d", 0, 1, "The owner shall keep logs. The sky is blue. The clerk must file forms."), ("d", 1, 2, None), ("d", 2, 3, "Terms.")]
    df = spark.createDataFrame(rows, "document_id string, chunk_id int, chunk_seq long, text string")
    return df.withColumns({"section_title_path": F.when(F.col("chunk_id") == 2, F.array(F.lit("1. Glossary"))).otherwise(F.array(F.lit("2. Duties"))), "section_ref_path": F.array(F.lit("2")), "parent_header_text": F.lit(None).cast("string"), "page_start": F.lit(1), "page_end": F.lit(1), "ingested_at": F.lit("2025-01-01").cast("timestamp_ntz")})


def test_ingest_and_ask(spark, chunks):
    got = ingest(chunks, providers.OfflineExtractor(["shall", "must"]), PROFILE)
    reqs = got.requirements
    assert sorted(x.source_quote for x in reqs.collect()) == ["The clerk must file forms.", "The owner shall keep logs."]
    emb = providers.OfflineEmbedder(16)
    vecs = providers.embedded(reqs.select("stable_id", "source_quote"), emb, "source_quote").select("stable_id", "dense")
    hits = ask("who must file forms", reqs.select("stable_id", "source_quote", "document_id", "chunk_id"), vecs, emb.embed, chunks, top_k=2, key="stable_id").collect()
    assert [h.rank for h in hits] == [1, 2] and "file forms" in hits[0].source_quote and hits[0].context_text


def test_stream_asks_once(spark, chunks, tmp_path):
    src, cache = str(tmp_path / "in"), str(tmp_path / "cache")
    flat = chunks.where("text is not null").drop("ingested_at")
    flat.write.json(src)
    for run in (1, 2):
        s = incremental.chunk_stream(spark, src, flat.schema)
        incremental.extract_stream(s, providers.OfflineExtractor(["shall"]), "m", cache, str(tmp_path / f"cp{run}")).awaitTermination(120)
    assert spark.read.parquet(cache).count() == 2
