"""Queries do the whole job: no row, check or pair is left out."""

import pyarrow as pa
import pyarrow.parquet as pq

from tarnloom.operators import splitting
from tarnloom.plans import registry
from tarnloom.plans.curation import curated
from tarnloom.plans.texts import issue_summary
from tarnloom.plans.windows import removal_priority

from .test_functions import _model_unpaired

registry.load()


def test_npz_of_every_vector(spark, tmp_path):
    vectors = [(i, None if i % 9 == 4 else [0.5] * (i % 3)) for i in range(45)]
    ids, values = map(list, zip(*vectors))
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(values, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["s13_npz"](spark, str(tmp_path)).collect())
    assert got == [(i, None if v is None else len(v)) for i, v in vectors]


def test_npz_of_the_test_table(spark, sf_dir):
    want = sorted((r.vec_id, len(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect())
    assert sorted(tuple(r) for r in registry.QUERIES["s13_npz"](spark, sf_dir).collect()) == want


def test_issue_summary_counts_unpaired_signs(spark):
    texts = ["(a", "b]", 'say "hi', "{c} (d) ok", "a  b", "a  (b", None, "plain", "((x))"]
    rows = [(i, t, ["train", "val", None][i % 3]) for i, t in enumerate(texts)]
    m = spark.createDataFrame(rows, "pos long, text string, split string")
    want = {}
    for _, t, s in rows:
        found = [] if t is None else ["15_unpaired"] * (_model_unpaired(t) != t) + ["03_multiple_spaces"] * ("  " in t)
        for issue in found + ["any"] * bool(found):
            want[issue, s] = want.get((issue, s), 0) + 1
    assert {(r.issue, r.split): r.texts for r in issue_summary(m).collect()} == want


def test_curation_compares_rows_with_one_word_fewer(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, "v1", text, 60.0, 10, "f", "s", "train"), (2, "v2", text, 60.0, 9, "f", "s", "val"), (3, "v3", "quite another caption", 60.0, 3, "f", "s", "val")]
    m = spark.createDataFrame(rows, "pos long, vid string, text string, duration_sec double, word_count int, file_path string, source string, split string")
    assert sorted(r.pos for r in curated(m).collect()) == [1, 3]
    assert [(r.pos, r.reason) for r in removal_priority(m).collect()] == [(2, "across")]


def test_curation_fixes_texts_once(spark, monkeypatch):
    """what is ranked, and so read more than once, is a written table: no fix and no join runs again."""
    ranked, stratified = [], splitting.stratified
    monkeypatch.setattr(splitting, "stratified", lambda df, *a: ranked.append(df) or stratified(df, *a))
    rows = [(1, "v1", "One two", 60.0, 2, "f", "s", "train"), (2, "v2", "Quite  another", 60.0, 2, "f", None, "val"), (3, "v3", "...", 60.0, 1, "f", "s", "val")]
    m = spark.createDataFrame(rows, "pos long, vid string, text string, duration_sec double, word_count int, file_path string, source string, split string")
    assert sorted((r.pos, r.text, r.source) for r in curated(m).collect()) == [(1, "One two", "s"), (2, "Quite another", None)]
    plan = ranked[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "regexp_replace" not in plan


def test_sinks_keep_vids_with_blanks_and_null(spark, tmp_path):
    vids = ["a", " b", "c ", None, " \td", 'e "f"', "g,h"]
    cols = {"vid": pa.array(vids, pa.string()), "detection_rate": pa.array([i / 8 for i in range(len(vids))])}
    cols |= {c: pa.array(range(len(vids)), pa.int32()) for c in ("x1", "y1", "x2", "y2")} | {"failed": pa.array([False] * len(vids))}
    pq.write_table(pa.table(cols), tmp_path / "bbox.parquet")
    for name in ("s06_csv_boxes", "k02_sorted_sink"):
        got = [r.vid for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
        assert len(got) == len(vids) and set(got) == set(vids), name
