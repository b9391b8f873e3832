import pyarrow as pa
import pytest

import corpus_pipeline
from vellum.llm import _tokens, packing, secrets
from vellum.llm._shared import materialize

from . import odd
from .test_sets import base_spans
from .test_similar import groups, linked_pairs
from .test_tokens_out import check_pieces


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, rows = docs.collect(), None
        docs = materialize(stage(spark, docs, sf_dir), f"test-{name}")
        rows = docs.collect()
        if name == "language":
            # the given texts are all prose in a learned language
            assert len(rows) >= 0.99 * len(before)
        if name == "near_duplicates":
            # what stays is at least one of each group that brute force finds, and hardly more
            ids = [r.doc_id for r in before]
            least = set(groups(linked_pairs([(r.doc_id, r.text) for r in before]), ids).tolist())
            # (two of these pairs, at 0.83, are beyond the radius or meet in no table)
            assert least <= {r.doc_id for r in rows} and len(rows) <= len(least) + 2
        if name == "secrets":
            assert len(rows) == len(before) and not any(base_spans(r.text) for r in rows)
            clean = {r.doc_id: r.text for r in before if "[secret]" not in r.text}
            assert sum(r.text == clean.get(r.doc_id) for r in rows) >= sum(not base_spans(t) for t in clean.values())
        if name == "mixing":
            assert {r.doc_id for r in rows} <= {r.doc_id for r in before}
        if name == "packing":
            check_pieces(rows, [(r.doc_id, r.text) for r in before], 2048)
            assert all(len(r.ids) == 4 * r.length for r in rows) and len({(r.row_id, r.piece) for r in rows}) == len(rows)
        else:
            assert docs.columns == names
    assert corpus_pipeline.run(spark, sf_dir).count() == len(rows)
    assert secrets.KINDS[0] == "assign"


def test_stages_take_odd_and_empty_tables(spark, sf_dir):
    for make in (odd.table, odd.empty, odd.clashing):
        docs = make(spark)
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf_dir), f"odd-{name}")
        docs.count()


class Tapped(Exception):
    """What a stage would have run in its tasks."""


class Tap:
    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        raise Tapped(run)


@pytest.mark.parametrize("whole", [True, False])
def test_a_packing_task_leaves_nothing_in_its_worker(spark, sf_dir, whole):
    with pytest.raises(Tapped) as tapped:
        corpus_pipeline.packing(spark, Tap(), sf_dir)
    code = _tokens.encoder(_tokens.vocabulary("byte_bpe_50k.json"))
    texts = ["some words here", None, "some other words"]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": texts, "row_id": [7, 8, 9]})
    rest = tapped.value.args[0](iter([batch, batch]))
    found = [next(rest)]
    assert len(code.held) >= 4
    if whole:
        found += list(rest)
    else:
        rest.close()
    assert not code.held and not code.older
    ids = [[*code.library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    for some in found:
        assert packing.widened(some["ids"], some["length"].to_numpy()).to_pylist() == [_tokens.array("I", x).tobytes() for x in ids]
