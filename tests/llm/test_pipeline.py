"""The pipeline's stages on a small table, each against a brute-force version of what it promises on its own input."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_against_brute_force import benchmark_hits, lines_left, near_components, same

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """The small tables with reflowed texts, benchmark passages in shuffled words, repeated rows and missing values added."""
    draw, folder = random.Random(8), tmp_path_factory.mktemp("tables")
    docs = pq.read_table(f"{SMALL}/documents.parquet")
    items = pq.read_table(f"{SMALL}/benchmark.parquet")
    good = [r for r in docs.to_pylist() if 100 < len(r["text"].split()) < 400][:30]
    more = [(" ".join(r["text"].split()), r) for r in good[:15]]
    for r, item in zip(good[15:], items["text"].to_pylist()):
        words = r["text"].split()
        draw.shuffle(words)
        more.append((" ".join([*words[:40], item, *words[40:]]), r))
    more += [("", good[0]), (None, good[0]), (good[20]["text"], good[20])]
    new = [{**r, "doc_id": 10_000 + k, "text": t, "n_chars": None if t is None else len(t)} for k, (t, r) in enumerate(more)]
    new += [{**new[3], "doc_id": None}, good[21]]
    pq.write_table(pa.concat_tables([docs, pa.Table.from_pylist(new, docs.schema)]), folder / "documents.parquet")
    for name in ("labels", "benchmark"):
        pq.write_table(pq.read_table(f"{SMALL}/{name}.parquet"), folder / f"{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def stages(spark, tables):
    """The input of each stage and, last, what the last one returns."""
    import corpus_pipeline as P

    out = [spark.read.parquet(f"{tables}/documents.parquet")]
    for _, stage in P.STAGES:
        out.append(P.cut(stage(spark, out[-1], tables)))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_names_and_columns(stages):
    import corpus_pipeline as P

    assert [k for k, _ in P.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
    assert all(x.columns == stages[0].columns for x in stages[:5])
    counts = [x.count() for x in stages]
    assert counts[0] > counts[1] >= counts[2] > counts[3] > counts[4] == counts[5] > 0


def test_classifier_keeps_what_scores_enough(spark, stages, tables):
    """Scores with every product of two features written out."""
    from tessera.llm import fm_quality as Q
    from tessera.llm.words import buffers

    rows = pairs(stages[0])
    m = Q.train(stages[0], spark.read.parquet(f"{tables}/labels.parquet"))
    kept = []
    for i, t in rows:
        _, f, x = Q.features(*buffers(pa.array([t], pa.large_string())), m.cuts)
        v = m.factor[f].astype(float) * x[:, None]
        z = m.bias + float(m.weight[f] @ x) + np.triu(v @ v.T, 1).sum()
        if z >= np.log(0.3 / 0.7):
            kept.append((i, t))
    same(pairs(stages[1]), kept)


def test_line_dedup_keeps_the_first_of_similar_lines(stages):
    rows = pairs(stages[1])
    want = [(i, new) for (i, old), (_, new) in zip(rows, lines_left(rows)) if new == old or new.strip(" \t\n\v\f\r")]
    same(pairs(stages[2]), want)
    assert any(new != old for (_, old), (_, new) in zip(rows, lines_left(rows)))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in stages[2].collect())


def test_near_dedup_keeps_one_of_each_component(stages):
    rows = pairs(stages[2])
    verdict = near_components(rows)
    same(pairs(stages[3]), [r for r, w in zip(rows, verdict) if w[3]])


def test_decontamination_drops_what_has_an_item(stages, tables):
    rows = pairs(stages[3])
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{tables}/benchmark.parquet").to_pylist()]
    same(pairs(stages[4]), [r for r, w in zip(rows, benchmark_hits(rows, items)) if not w[3]])


def test_encoding_equals_the_tokenizers_library(stages):
    from tokenizers import Tokenizer

    from tessera.llm.queries import vocabulary

    t = Tokenizer.from_file(vocabulary())
    want = []
    for i, text in pairs(stages[4]):
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want.append((i, ids, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    same([(r.doc_id, list(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in stages[5].collect()], want)
