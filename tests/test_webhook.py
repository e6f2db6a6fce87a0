"""Webhook ingest and signature (reference webhook cases)."""
import hashlib
import hmac
import json

from revlens.functions.hashing import hmac_sha256_hex, signature_ok
from revlens.sources.ingest import ingest_pr_events

PAYLOAD = {"action": "opened", "pull_request": {"id": 99999, "number": 42, "state": "open",
           "head": {"sha": "abc123"}, "base": {"sha": "def456"}, "user": {"login": "testuser"}},
           "repository": {"full_name": "org/repo"}}


def _raw(spark, items):
    return spark.createDataFrame(items, "delivery_id long, event_type string, payload string")


def test_accepts_opened_and_synchronize_with_all_fields(spark):
    p2 = dict(PAYLOAD, action="synchronize")
    out = ingest_pr_events(_raw(spark, [(1, "pull_request", json.dumps(PAYLOAD)),
                                        (2, "pull_request", json.dumps(p2))])).orderBy("delivery_id").collect()
    assert [r.outcome for r in out] == ["accepted", "accepted"]
    r = out[0]
    assert (r.repo_full_name, r.pr_number, r.external_pr_id, r.head_sha, r.base_sha, r.author, r.action) == \
        ("org/repo", 42, 99999, "abc123", "def456", "testuser", "opened")


def test_ignores_closed_action_and_other_event_type_and_rejects_missing_repo(spark):
    closed = dict(PAYLOAD, action="closed")
    norepo = {k: v for k, v in PAYLOAD.items() if k != "repository"}
    out = ingest_pr_events(_raw(spark, [(1, "pull_request", json.dumps(closed)),
                                        (2, "check_suite", json.dumps(PAYLOAD)),
                                        (3, "pull_request", json.dumps(norepo))])).orderBy("delivery_id").collect()
    assert [(r.outcome, r.reason) for r in out] == [("ignored", "ignored_action"), ("ignored", "ignored_event_type"),
                                                    ("rejected", "missing_repository")]


def test_signature_matches_python_hmac(spark):
    body = json.dumps(PAYLOAD)
    want = hmac.new(b"secret-key", body.encode(), hashlib.sha256).hexdigest()
    df = spark.createDataFrame([(body, "sha256=" + want), (body, "sha256=" + "0" * 64), (body, None)],
                               "payload string, sig string")
    got = df.select(hmac_sha256_hex("payload", "secret-key").alias("h"),
                    signature_ok("payload", "sig", "secret-key").alias("ok")).collect()
    assert got[0].h == want
    assert [r.ok for r in got] == [True, False, False]
