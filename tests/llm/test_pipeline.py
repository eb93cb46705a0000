import random

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F
from llm.conftest import components_of
from llm.test_documents import kept_lines, sets
from llm.test_mixing import targets

from textmill.llm.sentencepiece_codec import MODEL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    rng = random.Random(6)
    english = [f"{a}{b}" for a in ("the", "dog", "wor", "sleep", "ing") for b in ("ly", "ed", "er", "ness", "th")]
    german = [f"{a}{b}" for a in ("hund", "katz", "schla", "gro", "ung") for b in ("lich", "keit", "en", "ß", "sch")]
    rows = []
    for i in range(160):
        words = english if i % 3 else german
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 12))) for _ in range(rng.randint(1, 9))]
        rows.append((i, "\n".join(lines), "en" if i % 3 else "de", f"s{i % 4}"))
    for i in range(160, 190):  # near copies
        words = rows[i - 100][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), rows[i - 100][2], "s1"))
    rows += [(190, None, "en", "s0"), (191, "", "en", "s0"), (192, "123 456", None, None), (193, rows[1][1], "en", None)]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = documents(spark), []
    for name, stage in cp.STAGES:
        stage(spark, docs, "unused").write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((docs, after))
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_are_in_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "mix_sources", "sentencepiece"]
    assert cp.ORACLE_SQL is None


def test_language_stage_drops_what_has_no_language(steps):
    before, after = (texts(x) for x in steps[0])
    assert after == {i: t for i, t in before.items() if i not in (190, 191, 192)}
    assert steps[0][1].columns == COLUMNS


def test_line_stage(steps):
    before, after = steps[1]
    want = {i: t for i, t in kept_lines(list(texts(before).items())).items() if t.strip()}
    assert texts(after) == want and after.columns == COLUMNS
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_join_stage_keeps_the_first_of_each_group(steps):
    before, after = (texts(x) for x in steps[2])
    own = sets(list(before.items()), 5)
    links = []
    for a in own:
        for b in own:
            common = len(own[a] & own[b])
            if a < b and own[a] and own[b] and 100 * common >= 80 * (len(own[a]) + len(own[b]) - common):
                links.append((a, b))
    lead = components_of(own, links)
    assert after == {i: t for i, t in before.items() if lead[i] == i}


def test_join_stage_on_near_copies(spark):
    docs = documents(spark).where("text is not null")
    kept = texts(cp.near_duplicates(spark, docs, "unused"))
    own = sets(list(texts(docs).items()), 5)
    lead = components_of(own, [
        (a, b) for a in own for b in own
        if a < b and own[a] and own[b] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])
    ])
    assert set(kept) == {i for i in own if lead[i] == i} and len(kept) < len(own)


def test_mixing_stage_meets_its_targets(steps):
    before, after = steps[3]
    size = {}
    for r in before.collect():
        size[r.source] = size.get(r.source, 0) + len(r.text.split())
    taken = dict.fromkeys(size, 0)
    for r in after.collect():
        taken[r.source] += len(r.text.split())
        assert r.text == texts(before)[r.doc_id]
    for source, goal in targets(size).items():
        assert abs(taken[source] - goal) <= 0.1 * goal + 15
    assert after.columns == COLUMNS


def test_token_stage(steps):
    import sentencepiece

    original = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    before, after = steps[4]
    rows = after.collect()
    assert len(rows) == before.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    by_id = texts(before)
    assert all(list(r.ids) == original.encode(by_id[r.doc_id]) for r in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, "unused").count() == 0


def test_clashing_columns_pass_through(spark):
    names = ["score", "lang_pred", "common", "n_lines", "n_removed", "_id", "ids"]
    docs = documents(spark)
    for name in names:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    for stage in (cp.language, cp.lines, cp.near_duplicates, cp.mixture):
        docs = stage(spark, docs, "unused")
        assert docs.columns == COLUMNS + names
    rows = docs.collect()
    assert rows and all(r[n] == f"own {n}" for r in rows for n in names)
    assert cp.token_ids(spark, docs, "unused").count() == len(rows)


def test_whole_run(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = cp.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"] and out.count() > 0
