"""Every operator and every stage of the pipeline on one awkward table: nulls, empty, long and repeated texts, ties, columns of all helper names; and on an empty one."""

import math

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, language, neardup, packing, quality, secrets, sharding, toxicity

HELPERS = (
    "_score _raw _kid _kraw _place _lid label _id _digest _ws _n _step _pos _len _hash _text _bid _bdig secret_spans _base _maybe _hex _b64 _spans size digest gsize place rank slot ids grp list codes ratio v q key n score "
    "held_out class_id class_key n_links item items w_hash w_len w_text hit_positions text_digest bucket ball shard law start length offset sequence_id lang_pred predicted raw title"
).split()
ROWS = [(1, "the quick brown fox jumps over the lazy dog and on", "en", 1), (1, "the quick brown fox jumps over the lazy dog and on", "en", 1), (2, None, None, None), (3, "", "en", 0), (3, "", "en", 0), (None, "token = abcdefgh12 \t\x00 é😀", "fr", 3), (4, "lorem ipsum " * 40_000, "la", None), (5, "!!", None, 2), (None, None, None, None), (6, "ö" * 30, "de", 30)]
LABELS = [(1, 1, 0), (3, 0, 1), (6, 1, 1), (None, 1, 1), (1, 1, 0), (7, None, None)]


@pytest.fixture(scope="module")
def awkward(spark):
    base = spark.createDataFrame([(a, b, c, "s", d) for a, b, c, d in ROWS], "doc_id long, text string, lang string, source string, n_chars int")
    return base.select("*", *[F.lit(f"own {h}").alias(h) for h in HELPERS])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "Quick brown fox"), (2, None), (3, ""), (None, "lorem ipsum")], "item_id long, text string")


REPORTS = {
    "language": lambda d, la, b: language.report(d), "toxicity": lambda d, la, b: toxicity.report(d, la), "neardup": lambda d, la, b: neardup.report(d), "sharding": lambda d, la, b: sharding.shard(d),
    "decontamination": lambda d, la, b: decontaminate.report(d, b), "secrets": lambda d, la, b: secrets.report(d), "quality": lambda d, la, b: quality.report(d, la),
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_reports(awkward, labels, bench, name):
    got = REPORTS[name](awkward, labels, bench).collect()
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(r[0]) for r in ROWS)
    if "score" in got[0]:
        assert all(0 <= r["score"] <= 1 and not math.isnan(r["score"]) for r in got)
    assert REPORTS[name](awkward.limit(0), labels.limit(0), bench.limit(0)).count() == 0


def test_packing_of_awkward_rows(awkward):
    got = packing.pack(awkward).collect()
    whole = {}
    for r in got:
        whole.setdefault((r["doc_id"], r["doc_tokens"]), 0)
        whole[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert {i for i, _ in whole} == {a for a, *_ in ROWS}
    # Two rows of one id may have equal texts: then their pieces add up to twice the tokens.
    assert all(v in (n, 2 * n) for (_, n), v in whole.items())
    assert packing.pack(awkward.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_all_columns(spark, awkward, labels, bench, stage, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    kept = run(spark, awkward, str(tmp_path))
    assert kept.columns == awkward.columns
    for r in kept.collect():
        assert all(r[h] == f"own {h}" for h in HELPERS)
    assert run(spark, awkward.limit(0), str(tmp_path)).count() == 0


def test_pipeline_of_nothing(spark, awkward, labels, bench, tmp_path):
    for name, d in (("documents", awkward), ("labels", labels), ("benchmark", bench)):
        d.limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_sliced_benchmark_hits_the_same(spark, awkward, bench, monkeypatch):
    want = sorted(map(repr, decontaminate.report(awkward, bench).collect()))
    monkeypatch.setattr(decontaminate, "SLICE_WINDOWS", 1)
    assert sorted(map(repr, decontaminate.report(awkward, bench).collect())) == want
    monkeypatch.setattr(decontaminate, "FEW", 0)
    assert decontaminate.remove(awkward, bench).columns == awkward.columns


def test_language_scores_are_those_of_a_plain_loop(spark):
    rows = [(i, text, lang) for i, (text, lang) in enumerate([("ba lo mi", "x"), ("tsch heit ung", "y"), ("Eau ion, ou!", "z")] * 30)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mask = (1 << 64) - 1
    for text in ("ba lo ver", "Eau heit 12 ou", "mi", "ÉAU"):
        letters = [32] + [ord(c) if c.isalpha() else 32 for c in text.lower()] + [32]
        letters = [c for k, c in enumerate(letters) if k == 0 or not c == letters[k - 1] == 32]
        counts = {}
        for n in language.ORDERS:
            for k in range(len(letters) - n + 1):
                if n == 1 and letters[k] == 32:
                    continue
                h = 0
                for c in letters[k : k + n]:
                    h = (h * 0x100000001B3 + c + n) & mask
                place = ((h * 0x9E3779B97F4A7C15) & mask) >> (64 - language.BITS)
                counts[place] = counts.get(place, 0) + 1
        x = {p: math.log1p(c) * model["idf"][p] for p, c in counts.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        z = [(sum(v / size * model["w"][p][k] for p, v in x.items()) + model["w"][language.DIMS][k]) / model["t"] for k in range(len(model["langs"]))]
        e = [math.exp(v - max(z)) for v in z]
        lang, score = language.predict_text(text, model)
        assert lang == model["langs"][e.index(max(e))] and score == pytest.approx(max(e) / sum(e))


def test_quality_scores_are_those_of_a_plain_loop(spark):
    import zstandard

    docs = spark.createDataFrame([(i, ("good words in a row " + str(i)) * 30 if i % 2 else "BAD!!" * (40 + i)) for i in range(40)], "doc_id long, text string")
    model = quality.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality"))
    for text in ("good words in a row and more", "BAD!!BAD!!" * 900, "é"):
        total, e = 0, text.encode()
        for at in range(0, len(e), quality.BLOCK):
            sizes = [len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(model[k]), write_content_size=False, write_checksum=False).compress(e[at : at + quality.BLOCK])) for k in ("bad", "good")]
            total += sizes[0] - sizes[1]
        assert quality.difference(text, model["good"], model["bad"]) == total / len(e)
