"""The pipeline's stages against plain code, on a small corpus where each has something to do."""

import hashlib
import os
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tablescope.llm import mixing
from tablescope.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")
SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    pick = random.Random(3)
    plain = ["".join(pick.choices(["re", "ta", "lin", "mo", "che"], k=3)) for _ in range(400)]
    rows, labels = [], []
    for i in range(420):
        words = pick.choices(plain, k=pick.randrange(20, 80))
        if i % 7 == 0:
            for _ in range(3):
                words[pick.randrange(len(words))] = "vexbag"
        rows.append([i, " ".join(words), "en", f"s{i % 3}" if i % 10 else None, 0])
        labels.append((i, 1, int(i % 7 == 0)))
    for i in range(1, 60, 7):  # near copies of clean documents, the later id goes
        rows.append([1000 + i, rows[i][1] + " tail", "en", "s1", 0])
    rows[2][1] += " password = 0123456789abcdefgh"
    rows.append([2000, None, "en", None, 0])
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r[0]: r[1] for r in rows}

    held = {}
    frame = docs
    for name, stage in pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        frame.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        held[name] = frame.collect()
        if name != "bpe_encoding":
            assert frame.columns == docs.columns
    ids = {n: sorted(r.doc_id for r in rs) for n, rs in held.items()}
    clean = sorted(i for i in texts if not (i < 420 and i % 7 == 0))
    assert ids["toxicity"] == clean
    assert ids["ngram_jaccard_join"] == [i for i in clean if not 1000 < i < 2000] == ids["secret_scan"]
    redacted = {r.doc_id: r.text for r in held["secret_scan"]}
    assert {i: t for i, t in redacted.items() if i != 2} == {i: texts[i] for i in redacted if i != 2}
    assert redacted[2].endswith(" [SECRET]") and "0123456789" not in redacted[2]
    times = {r.doc_id: r.times for r in mixing.mixed_sizes(spark.read.parquet(f"{tmp_path}/secret_scan")).collect()}
    assert ids["source_mixing"] == sorted(i for i, n in times.items() for _ in range(n))
    tokenizer = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    assert ids["bpe_encoding"] == ids["source_mixing"]
    for r in held["bpe_encoding"]:
        text = redacted[r.doc_id] or ""
        assert list(memoryview(r.ids).cast("I")) == tokenizer.encode(text, add_special_tokens=False).ids
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    again = pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, bytes(r.ids)) for r in again.collect()) == sorted((r.doc_id, bytes(r.ids)) for r in held["bpe_encoding"])


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not mounted")
@pytest.mark.parametrize("name", ["op1_weakly_supervised_pii", "op2_risk_controlled_quality", "op4_source_mixing"])
def test_native_plans_hold_no_python(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
