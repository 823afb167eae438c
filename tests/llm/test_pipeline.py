"""The pipeline against the same stages written plainly."""

import hashlib
import re
import struct
import zlib
from pathlib import Path

import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from screenlake.llm import language_id, secret_scan
from screenlake.llm.common import table

DATA = Path("/root/testdata/sf0.001")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_pipeline_equals_plain_stages(spark):
    docs = table(spark, str(DATA), "documents")
    model = language_id.fit(docs)
    predict = model.predictor()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {i: t for i, t in texts.items() if (p := predict(t))[0] != "und" and p[1] >= model.threshold}
    seen: dict[str, int] = {}
    for i in sorted(kept):
        seen.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i]).encode()).hexdigest(), i)
    kept = {i: kept[i] for i in seen.values()}
    prints = {i: fingerprint(t) for i, t in kept.items()}
    label = {i: i for i in kept}
    changed = True
    while changed:
        changed = False
        for i in kept:
            for j in kept:
                if label[j] < label[i] and (prints[i] ^ prints[j]).bit_count() <= 4:
                    label[i], changed = label[j], True
    kept = {i: secret_scan.redacted(t) for i, t in kept.items() if label[i] == i}
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in kept.items():
        ids = coder.encode(t, add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.add((i, k // 4096, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    got = corpus_pipeline.run(spark, str(DATA)).collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    sequences: dict[int, list] = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_stages_keep_the_columns(spark):
    docs = table(spark, str(DATA), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(DATA)).columns == docs.columns, name
