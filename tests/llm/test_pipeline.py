import random
import shutil
import string
import subprocess
import sys
from pathlib import Path

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

import corpus_pipeline
from textpair.llm import minhash, packing
from textpair.llm.catalog import LLM_ORACLES, LLM_QUERIES
from textpair.llm.common import read_table, stored

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    assert difference(LLM_QUERIES[name](spark, sf_dir), connect(sf_dir), LLM_ORACLES[name]) is None


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 11))


def test_stages_one_by_one(spark, sf_dir):
    """Each stage on what its predecessor kept: columns, subsets, and what it promises."""
    docs = read_table(spark, sf_dir, "documents")
    columns = docs.columns
    quality, language, near, mixing, pack = (stage for _, stage in corpus_pipeline.STAGES)
    labels = {r.doc_id: r.quality for r in read_table(spark, sf_dir, "labels").collect()}

    good = stored(quality(spark, docs, sf_dir), "test-quality")
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    clean = [d for d, q in labels.items() if q == 1]
    junk = [d for d, q in labels.items() if q == 0]
    assert good.columns == columns and good.join(docs, columns, "left_anti").count() == 0
    assert sum(d in kept for d in clean) >= 0.98 * len(clean) and sum(d in kept for d in junk) <= 0.25 * len(junk)

    known = stored(language(spark, good, sf_dir), "test-language")
    assert known.columns == columns and known.count() >= 0.99 * good.count()

    single = stored(near(spark, known, sf_dir), "test-near")
    components = minhash.near_duplicates(known, corpus_pipeline.NEAR_DUPLICATE_PERCENT)
    assert single.columns == columns
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in components.collect()}
    assert single.count() == single.select("doc_id").distinct().count()

    mixed = stored(mixing(spark, single, sf_dir), "test-mixed")
    size = F.size(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    words = [df.agg(F.sum(size)).first()[0] for df in (single, mixed)]
    assert mixed.columns == columns and abs(words[1] - 1.5 * words[0]) <= 20

    pieces = pack(spark, mixed, sf_dir).collect()
    assert sum(p.length for p in pieces) == packing.tokenised(mixed, packing.public_tokenizers.path(packing.RANKS)).agg(F.sum("tokens")).first()[0]


def test_run_gives_pieces(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert pieces.count() > 100


def test_the_rest_works_without_these_folders(tmp_path):
    for name in ("__spark_entry__.py", "textpair"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rouge_1' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_stages_from_near_dedup_on(spark, sf_dir):
    """Near-dedup keeps one document of each component at the pipeline's own percentage; what follows takes those."""
    docs = read_table(spark, sf_dir, "documents")
    single = stored(corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir), "test-near")
    components = minhash.near_duplicates(docs, 80)
    assert single.columns == docs.columns
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in components.collect()}
    assert single.count() == single.select("doc_id").distinct().count()
    mixed = stored(corpus_pipeline.mixing_stage(spark, single, sf_dir), "test-mixed")
    size = F.size(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    words = [df.agg(F.sum(size)).first()[0] for df in (single, mixed)]
    assert mixed.columns == docs.columns and abs(words[1] - 1.5 * words[0]) <= 20


FOREIGN = [
    "Lapset leikkivät ulkona kun heidän vanhempansa juovat kahvia sisällä ja puhuvat eilisestä säästä naapurin kanssa",
    "Dzieci bawią się na dworze podczas gdy ich rodzice piją kawę i rozmawiają o wczorajszej pogodzie z sąsiadem",
    "De kinderen spelen buiten terwijl hun ouders binnen koffie drinken en over het weer van gisteren praten met de buurman",
    "Дети играют на улице пока их родители пьют кофе и говорят о вчерашней погоде с соседом",
    "孩子们在外面玩耍他们的父母在里面喝咖啡谈论昨天的天气",
]


def test_language_stage_rejects_what_is_in_no_learned_language(spark, sf_dir):
    """Unlabelled foreign texts and random letters go; clean documents stay."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    clean = {r.doc_id for r in read_table(spark, sf_dir, "labels").where("quality = 1").collect()}
    rng = random.Random(4)
    letters = [" ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randrange(2, 10))) for _ in range(n)) for n in (3, 20, 200)]
    bad = [(10**6 + i, text, None) for i, text in enumerate([*FOREIGN, *letters])]
    mixed = docs.union(spark.createDataFrame(bad, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, mixed, sf_dir).collect()}
    assert not kept & {r[0] for r in bad}
    assert clean <= kept and len(kept) >= 0.99 * docs.count()
