import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from calibra.llm import wavelet as W
from calibra.llm.tokens import load_tokenizer
from calibra.llm.warc import DamagedRecord, _unquoted, archive, digest32, pack_record, read_records


@pytest.mark.parametrize("n, values", [(0, 5), (1, 1), (5000, 300), (3000, 2), (4096, 70_000)])
def test_wavelet_file(n, values, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_BITS", 256)
    rng = np.random.default_rng(n)
    a = rng.integers(0, values, n).astype(np.uint32)
    index = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([n])], names=["doc_id", "length"])
    raw = b"".join(W.build(a, index))
    f = W.WaveletFile(lambda at, size: raw[at:at + size])
    assert f.ids().tolist() == a.tolist() and f.index().to_pydict() == {"doc_id": [7], "length": [n]}
    assert f.count(999_999) == 0
    for i in rng.integers(0, n, 30) if n else []:
        t = int(a[i])
        places = np.flatnonzero(a == t)
        k, (lo, hi) = int(rng.integers(0, len(places))), sorted(rng.integers(0, n + 1, 2).tolist())
        assert f.access(int(i)) == t and f.count(t) == len(places) and f.find(t, k) == places[k]
        assert f.count(t, lo, hi) == int((a[lo:hi] == t).sum())


def test_token_files(docs, word_bpe, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["cat ", "Dog. ", "\n", "é", "42 "]) for _ in range(rng.randint(0, 300)))) for i in range(120)]
    rng.shuffle(rows)
    rows += [(500, None), (501, ""), (502, "long " * 30_000), (60, rows[0][1])]
    table = docs(rows).repartition(7).withColumnRenamed("lang", "k").withColumnRenamed("source", "p")
    monkeypatch.setattr(W, "SLICE", 4000)
    manifest, back = W.token_files(table, word_bpe, shard_ids=2000)
    assert manifest.count() > 3
    tok = load_tokenizer(word_bpe)
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in back.collect()) == sorted(want)
    assert W.token_files(docs([]), word_bpe)[1].count() == 0


def test_records_round_trip_and_damage():
    rows = [(1, "http://a/é x%20", b"<p>" * 50_000, None), (2, None, b"", None), (3, "u\n v", b"abc\r\n\r\nd", 1), (None, "", b"x", 2)]
    raw = b"".join(pack_record(*r) for r in rows)
    for (key, url, payload, refers), r in zip(rows, read_records(io.BytesIO(raw).read), strict=True):
        uri = r.headers.get("WARC-Target-URI")
        assert (uri if uri is None else _unquoted(uri)) == url
        assert (r.payload_bytes, r.digest) == (len(payload), digest32(payload))
        assert r.payload == (b"" if refers else payload) and r.headers.get("X-Page-ID") == (None if key is None else str(key))
    for bad in (raw[:10], raw[:-3], raw[:40] + bytes([raw[40] ^ 255]) + raw[41:]):
        with pytest.raises(DamagedRecord):
            list(read_records(io.BytesIO(bad).read))
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    forged = zlib.decompress(pack_record(1, "u", b"payload", None), 31).replace(b"payload\r\n", b"pay1oad\r\n")
    with pytest.raises(DamagedRecord):
        list(read_records(io.BytesIO(z.compress(forged) + z.flush()).read))


def test_archive(spark):
    rows = [(i, f"http://h/{i}", "same page") for i in range(9, 0, -1)] + [
        (20, "u", None), (21, None, ""), (22, "é \n%", "<p>" * 100_000), (1, "http://h/1", "same page"), (None, "n", "same page"), (None, "m", "only here")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("sha", F.lit("x")).repartition(5)
    got = sorted((tuple(r) for r in archive(pages).collect()), key=repr)
    first = {"same page": 1, "": 20}
    want = []
    for k, u, h in rows:
        b = (h or "").encode()
        refers = first.get(h or "")
        refers = None if refers is None or refers == k else refers
        want.append((k, u, len(b), digest32(b), "revisit" if refers is not None else "response", refers))
    assert got == sorted(want, key=repr)
    assert archive(pages, min_bytes=100).where("record_type = 'revisit'").count() == 0
    payloads = archive(pages, payloads=True).where("page_id = 22").first().payload
    assert bytes(payloads) == b"<p>" * 100_000
    assert archive(pages.limit(0)).count() == 0
