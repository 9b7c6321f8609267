"""Payload decoding and dead letters (F3-F5, C7) on hand-made payloads."""

import base64
import datetime as dt
import json

from shelfmark import schemas as S
from shelfmark.operators import events

T0 = dt.datetime(2024, 1, 1)
BASE = {"kind": "storage#object", "id": "b/o/1", "selfLink": "https://x/b/o", "name": "ds/p.csv",
        "bucket": "b", "size": "12", "timeCreated": "2024-01-01T00:00:00Z",
        "updated": "2024-01-01T00:00:00Z", "timeStorageClassUpdated": "2024-01-01T00:00:00Z",
        "extraUnknownKey": {"ignored": True}}


def b64(obj):
    return base64.b64encode(json.dumps(obj).encode()).decode()


def with_(**kw):
    d = dict(BASE)
    for k, v in kw.items():
        if v is None:
            d.pop(k)
        else:
            d[k] = v
    return d


CASES = [
    ("ok", b64(BASE), S.EVENT_FINALIZE, None, 12),
    ("plus", b64(with_(size="+7")), S.EVENT_FINALIZE, None, 7),
    ("neg", b64(with_(size="-3")), S.EVENT_FINALIZE, None, -3),
    ("blank", b64(with_(size=" 12 ")), S.EVENT_FINALIZE, "size is not an integer", None),
    ("decimal", b64(with_(size="12.5")), S.EVENT_FINALIZE, "size is not an integer", None),
    ("overflow", b64(with_(size="99999999999999999999")), S.EVENT_FINALIZE, "size is not an integer", None),
    ("nosize", b64(with_(size=None)), S.EVENT_FINALIZE, "missing key size", None),
    ("noname", b64(with_(name=None)), S.EVENT_FINALIZE, "missing key name", None),
    ("noupdated", b64(with_(updated=None)), S.EVENT_FINALIZE, "missing key updated", None),
    ("emptyname", b64(with_(name="")), S.EVENT_FINALIZE, "empty object name", None),
    ("badtype", b64(BASE), "OBJECT_EXPLODED", "unknown event type", None),
    ("notb64", "@@@", S.EVENT_FINALIZE, "undecodable payload", None),
    ("notjson", base64.b64encode(b"not json").decode(), S.EVENT_FINALIZE, "undecodable payload", None),
    ("array", base64.b64encode(b"[1, 2]").decode(), S.EVENT_FINALIZE, "undecodable payload", None),
]


def test_decode_reasons(spark):
    rows = [(f"ack-{n}", n, T0, et, T0, "obj", None, data) for n, data, et, _, _ in CASES]
    flat = spark.createDataFrame(rows, "ack_id string, message_id string, publish_time timestamp_ntz, "
                                       "event_type string, event_time timestamp_ntz, object_id string, "
                                       "overwritten_by_generation string, data string")
    got = {r.message_id: (r.reason, r.size) for r in events.decode_notifications(flat).collect()}
    for n, _, _, reason, size in CASES:
        assert got[n][0] == reason, n
        if reason is None:
            assert got[n][1] == size, n
    ok, dead = events.decode_payload(flat)
    assert ok.count() == 3 and dead.count() == len(CASES) - 3
    routed = {r.message_id: r.action for r in events.route_events(
        events.decode_notifications(flat), spark.createDataFrame([(1, "ds")], "dataset_id long, dataset_name string")
    ).collect()}
    assert routed["ok"] == "upsert" and routed["notb64"] == "dead_letter"
