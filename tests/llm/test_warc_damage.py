"""Archives that are cut short, altered or written by others."""
import hashlib

import pytest

from reportloom.llm import warc

SHA = lambda b: hashlib.sha256(b).hexdigest()
WEB = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n"


def record(kind, body, **fields):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in {"WARC_Type": kind, "Content_Length": len(body), **fields}.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def response(page, payload, stated=None, **fields):
    return record("response", WEB + payload, WARC_Record_ID=f"<urn:page:{page}>", WARC_Payload_Digest=f"sha256:{SHA(stated or payload)}", X_Payload_Length=len(stated or payload), **fields)


def more(page, k, payload, total=None):
    return record("continuation", payload, WARC_Record_ID=f"<urn:page:{page}:{k}>", WARC_Segment_Number=k, WARC_Segment_Origin_ID=f"<urn:page:{page}>", WARC_Segment_Total_Length=total)


@pytest.fixture
def read(spark, tmp_path):
    def of(*files):
        for k, raw in enumerate(files):
            (tmp_path / f"{k}.warc").write_bytes(raw)
        return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.intact) for r in warc.archive_digest(spark, str(tmp_path)).collect()}

    return of


def whole(payload, kind="response", intact=True):
    return len(payload), SHA(payload), kind, intact


def test_altered(read):
    got = read(response(1, b"good") + response(2, b"evil", stated=b"fine") + response(3, b"") + response(4, b"a\r\n\r\nb"), response(5, b"long", Content_Length=len(WEB) + 2) + response(6, b"next"), response(7, b"x", Content_Length="?") + response(8, b"y"))
    assert got[1] == whole(b"good") and got[2] == whole(b"evil", intact=False) and got[3] == whole(b"") and got[4] == whole(b"a\r\n\r\nb")
    assert got[5] == whole(b"lo", intact=False) and got[6] == whole(b"next")
    assert got[7] == whole(b"", intact=False) and got[8] == whole(b"y")


def test_cut_short(read):
    first = dict(stated=b"onetwo", WARC_Segment_Number=1)
    total = len(WEB) + 6
    got = read(
        response(1, b"one\r\ntwo")[:-8], response(2, b"x")[:-30], response(3, b"one", **first) + response(4, b"y"), response(5, b"one", **first),
        response(6, b"one", **first) + more(6, 2, b"two", total), more(7, 2, b"two", total), response(8, b"one", **first) + more(8, 2, b"two", total + 1), response(9, b"one", **first) + more(10, 2, b"two", total),
        b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:11>\r\nContent-Len",
    )
    assert got[1] == whole(b"one\r", intact=False)
    assert got[2][3] is False and got[4] == whole(b"y") and got[6] == whole(b"onetwo")
    assert got[3] == got[5] == got[9] == whole(b"one", intact=False)
    assert got[7] == got[10] == (3, SHA(b"two"), "continuation", False)
    assert got[8] == whole(b"onetwo", intact=False) and got[11] == whole(b"", intact=False)


def test_one_segment_comes_in_chunks(spark, tmp_path):
    payload = b"\r\n".join(b"line %d" % i for i in range(60_000)) + b"\r\n"
    (tmp_path / "a.warc").write_bytes(record("warcinfo", b"software: x\r\n", WARC_Record_ID="<urn:info>") + response(1, payload))
    rows = sorted(warc.read_chunks(spark, str(tmp_path)).where("record_id = '<urn:page:1>'").collect(), key=lambda r: r.chunk)
    assert len(rows) > 5 and [r.chunk for r in rows] == list(range(1, len(rows) + 1)) and max(len(r.data) for r in rows) < 5 * warc.CHUNK
    assert b"".join(r.data for r in rows) == payload and [r.last for r in rows] == [False] * (len(rows) - 1) + [True]
    assert rows[-1].digest_so_far == SHA(payload) and rows[-1].intact and rows[0].intact is None
