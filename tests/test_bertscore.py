"""BERTScore by a small model that is made here, against its definition in loops."""

from __future__ import annotations

import math

import numpy as np
import pytest

from conftest import SF
from gridscribe.functions import bertscore as B, metrics as M

WORDS = ("[UNK]", "[CLS]", "[SEP]", "fatal", "death", "in", "5", "subjects", "nausea", ".")


def field(number: int, value) -> bytes:
    """A field of a protocol buffer: a number, or what has a length."""

    def varint(n: int) -> bytes:
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def shaped(name: str, kind: int, *dims: str) -> bytes:
    return field(1, name) + field(2, field(1, field(1, kind) + field(2, b"".join(field(1, field(2, d)) for d in dims))))


@pytest.fixture(scope="module")
def model(tmp_path_factory):
    """(folder, vectors): a model that looks a word's vector up, and a tokenizer that reads six tokens at once, two of them marks."""
    from tokenizers import Tokenizer, models, pre_tokenizers, processors

    folder = tmp_path_factory.mktemp("model")
    v = np.random.default_rng(4).normal(size=(len(WORDS), 5)).astype("float32")
    v[WORDS.index("death")] = v[WORDS.index("fatal")] + 0.1
    table = b"".join(field(1, n) for n in v.shape) + field(2, 1) + field(8, "table") + field(9, v.tobytes())
    node = field(1, "table") + field(1, "input_ids") + field(2, "vectors") + field(4, "Gather")
    graph = field(1, node) + field(2, "g") + field(5, table) + field(11, shaped("input_ids", 7, "b", "n")) + field(12, shaped("vectors", 1, "b", "n", "d"))
    (folder / "model.onnx").write_bytes(field(1, 8) + field(7, graph) + field(8, field(2, 13)))
    t = Tokenizer(models.WordLevel({w: i for i, w in enumerate(WORDS)}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    t.post_processor = processors.TemplateProcessing(single="[CLS] $A [SEP]", special_tokens=[("[CLS]", 1), ("[SEP]", 2)])
    t.enable_truncation(6)
    t.save(str(folder / "tokenizer.json"))
    return str(folder), v.astype(float)


def by_definition(v, text, reference):
    unit = lambda w: v[WORDS.index(w) if w in WORDS else 0] / math.sqrt(sum(v[WORDS.index(w) if w in WORDS else 0] ** 2))
    a, b = text.split(), reference.split()
    if not a or not b:
        return 0.0
    best = lambda x, other: sum(max(float(unit(w) @ unit(o)) for o in [*other, "[CLS]", "[SEP]"]) for w in x) / len(x)
    p, q = best(a, b), best(b, a)
    return 2 * p * q / (p + q)


def test_f1_by_definition(model, monkeypatch):
    folder, v = model
    long = "fatal in 5 subjects . nausea in 5 subjects . death unknown in 5 fatal"
    monkeypatch.setattr(B, "ROWS", 4)
    for g, r in (("fatal in 5 subjects", "death in 5 subjects"), (long, "nausea . death"), ("nausea", long), (long, long), ("", "fatal"), ("  ", ""), ("unknown", "death")):
        assert B.f1(B.encoder(folder).vectors(g), B.encoder(folder).vectors(r)) == pytest.approx(by_definition(v, g, r), abs=1e-6), (g, r)
    assert B.encoder(folder).vectors(long)[1].sum() == len(long.split())


def test_whole_evaluation_scores_by_the_model(spark, model):
    folder, v = model
    rows = [("near", "fatal in 5 subjects", "death in 5 subjects", "Fatal | 5"), ("no reference", "fatal", None, "Fatal | 5"), ("no text", None, "fatal", "Fatal | 5")]
    df = spark.createDataFrame(rows, "mode string, generated string, reference string, table_text string")
    got = {r["mode"]: r for r in M.evaluate_whole(df, ("Placebo", "Drug A"), model=folder).collect()}
    near = got["near"]
    assert near["bertscore_f1"] == pytest.approx(by_definition(v, *rows[0][1:3]), abs=1e-6) and near["bertscore_f1"] > 0.9 and near["errors"] == []
    assert near["fluency_score"] == pytest.approx(0.3 * near["rouge_l"] + 0.45 * near["bertscore_f1"] + 0.25 * near["meteor"])
    assert got["no reference"]["bertscore_f1"] == 0.0 == got["no text"]["bertscore_f1"] and [e.split(":")[0] for e in got["no reference"]["errors"]] == list(M.TEXT_METRICS)
    none = M.evaluate_whole(df.where("mode = 'near'"), ("Placebo", "Drug A"), model=folder + "/none").first()
    assert none["bertscore_f1"] == 0.0 and none["meteor"] == near["meteor"] and [e.split(":")[0] for e in none["errors"]] == ["bertscore_f1"]


def test_the_query_takes_the_model_of_the_session(spark, model):
    from gridscribe.plans.scoring import whole_evaluation

    assert {(r["bertscore_f1"], r["errors"].count("bertscore_f1: no ")) for r in whole_evaluation(spark, SF).collect()} == {(0.0, 1)}
    spark.conf.set(B.MODEL, model[0])
    try:
        rows = whole_evaluation(spark, SF).collect()
    finally:
        spark.conf.unset(B.MODEL)
    assert {r["bertscore_f1"] > 0 for r in rows if r["errors"] == ""} == {True} and {r["bertscore_f1"] for r in rows if "bertscore_f1" in r["errors"]} <= {0.0}
