"""The pipeline against a plain version of each stage, fed with the stage's own input."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from letterlake.llm import quality  # noqa: E402
from letterlake.llm.common import materialise  # noqa: E402
from tests.llm.test_operators import SCHEMA, brute_lines, prose, words  # noqa: E402


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    rng = random.Random(12)
    root = tmp_path_factory.mktemp("pipeline")
    line = lambda: prose(14, rng).replace("\n", " ")
    body = lambda: "\n".join(line() for _ in range(rng.randint(3, 6)))
    items = [prose(30, rng) for _ in range(4)]
    texts = [body() for _ in range(60)]
    texts += [texts[0], texts[1] + "\n" + line(), line() + "\n" + texts[2].split("\n")[0], "too short", None, "### " * 50, items[0] + "\n" + line(), texts[3].replace("e", "E", 1)]
    data = [dict(zip(SCHEMA.names, (k, t, "en", rng.choice(["a", "b", "c"]), len(t or "")))) for k, t in enumerate(texts)]
    pq.write_table(pa.Table.from_pylist(data + data[5:6], SCHEMA), root / "documents.parquet")
    pq.write_table(pa.table({"item_id": list(range(4)), "text": items}), root / "benchmark.parquet")
    return root, items


def test_stages(spark, tables):
    root, items = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before = [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, str(root)), "test-stage")
        after = [tuple(r) for r in docs.collect()]
        if name != names[-1]:
            assert docs.columns == SCHEMA.names
        if name == "quality rules":
            lost = {r[0] for r in before} - {r[0] for r in after}
            assert {63, 64, 65} <= lost and len(lost) <= 5
        if name == "line dedup":
            gone = brute_lines(before)
            expected = []
            for r, drop in zip(before, gone):
                text = "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in drop)
                if not drop:
                    expected.append(r)
                elif text.strip():
                    expected.append((r[0], text, r[2], r[3], len(text)))
            assert sorted(map(repr, after)) == sorted(map(repr, expected)) and any(gone)
        if name == "n-gram Jaccard join":
            sets = [frozenset(tuple(words(r[1])[i : i + 5]) for i in range(max(len(words(r[1])) - 4, 1))) for r in before]
            kept = [r for k, r in enumerate(before) if not any(len(sets[k] & s) >= 0.8 * len(sets[k] | s) and (q[0], j) < (r[0], k) for j, (q, s) in enumerate(zip(before, sets)))]
            assert sorted(map(repr, after)) == sorted(map(repr, kept))
        if name == "benchmark decontamination":
            windows = {tuple(words(t)[i : i + 13]) for t in items for i in range(len(words(t)) - 12)}

            def clean(text):
                w = words(text)
                hit = {j for i in range(len(w) - 12) if tuple(w[i : i + 13]) in windows for j in range(i, i + 13)}
                return not hit or 20 * len(hit) < len(w)

            assert sorted(map(repr, after)) == sorted(repr(r) for r in before if clean(r[1])) and len(after) < len(before)
        if name == "source mix":
            at = {c: docs.columns.index(c) for c in docs.columns}
            for source in {r[at["source"]] for r in after}:
                own = [r for r in after if r[at["source"]] == source]
                assert abs(sum(r[at["taken"]] for r in own) - own[0][at["target"]]) <= 200
            assert all(r[at["copies"]] > 0 for r in after)
        before = after


def test_run_equals_its_stages(spark, tables):
    root, _ = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, str(root)), "test-stage")
    assert sorted(map(repr, docs.collect())) == sorted(map(repr, corpus_pipeline.run(spark, str(root)).collect()))
    assert quality.MIN_DOCS > 0
