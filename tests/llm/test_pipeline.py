"""The corpus pipeline on a small folder, against a brute-force version of its stages."""

import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_dedup import brute_components, words


def test_stages_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(12)
    plain = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu", "ha") for b in ("lan", "mer", "nit", "pol", "ras", "tev", "wix", "zod")]
    plain = [x + y for x in plain for y in ("", "en", "is", "o")]
    text = lambda n: list(rng.choice(plain, n))
    passage, rows, toxic = text(60), [], set()
    for k in range(120):
        t = text(int(rng.integers(60, 120)))
        if k % 4 == 0:
            toxic.add(k)
            for at in rng.integers(0, len(t), 8):
                t[at] = "vorxile" if at % 2 else "quaggum"
        if k % 10 == 3:
            t = t[:20] + passage + t[20:]
        rows.append((k, " ".join(t)))
    near = rows[5][1].split()
    near[10] = "changed"
    rows += [(200, rows[1][1]), (201, rows[1][1].replace(" ", "  ")), (202, " ".join(near)), (203, ""), (204, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    now = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns, name

    left = [(i, t) for i, t in rows if i not in toxic]
    seen, unique = set(), []
    for i, t in left:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if key not in seen:
            seen.add(key)
            unique.append((i, t))
    component, _ = brute_components(unique, 80)
    unique = [(i, t) for i, t in unique if component[i] == i]
    want, held = {}, set()
    for i, t in unique:
        w = words(t)
        gone = set()
        for k in range(len(w) - 49):
            if tuple(w[k : k + 50]) in held:
                gone |= set(range(k, k + 50))
        held |= {tuple(w[k : k + 50]) for k in range(len(w) - 49)}
        want[i] = [x for k, x in enumerate(w) if k not in gone]
    got = {r["doc_id"]: words(r["text"]) for r in now.collect()}
    assert set(got) == set(want)
    for i in want:  # a word beside a passage may agree with another of its documents by chance
        rest = iter(got[i])
        assert all(x in rest for x in want[i]) and len(got[i]) - len(want[i]) <= 2
    assert sum(len(got[i]) != len(want[i]) for i in want) <= 2

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r["doc_id"]: r["text"] for r in now.collect()}
    assert {r["doc_id"]: r["doc_tokens"] for r in packed} == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items()}


def test_stages_of_nothing_and_with_more_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n long, key string, hash string, spans string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(1, "a b c", "en", "s", 5, True, 1, "k", "h", "x"), (2, "a b  c", "en", "s", 6, True, 1, "k", "h", "x"), (None, None, "en", "s", None, None, 1, "k", "h", "x"), (4, "", "en", "s", 0, False, 1, "k", "h", "x")]
    for docs in (spark.createDataFrame([], schema), spark.createDataFrame(rows, schema)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, str(tmp_path))
            assert out.schema.simpleString() == docs.schema.simpleString()
            docs = out
        left = sorted((r["doc_id"] is None, r["doc_id"]) for r in docs.collect())
        assert left in ([], [(False, 1), (False, 4), (True, None)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
