"""Rules: one clean row set, one fault at a time, one named refusal each."""

import hashlib

import pytest
from pyspark.sql import functions as F

from timesift.operators import audit, keyed, quality

SHA, COMMIT = "a" * 64, "b" * 40
COMMON = {"schema_version": 1, "created_at_utc": "2026-07-12T00:00:00Z", "packet_id": "P03", "status": "complete", "control_commit": COMMIT,
          "candidate_commit": COMMIT, "candidate_config_hash": SHA, "plan_sha256": SHA}
CLEAN = {
    "run": {"case_id": "c", "arm": "control", "attempt": 1, "order": 1, "result_state": "success", "failure_class": None, "raw_manifest_path": "m/x.json"},
    "judgment": {"case_id": "c", "arm": "control", "correctness": 8, "completeness": 8, "citation": 8, "adherence": 8, "refused": False, "citations_checked": 3},
    "usage": {"case_id": "c", "arm": "control", "attempt": 1, "reader_text_tokens": 5, "dollars": 0.5, "measurement_kind": "reported", "measurement_source": "provider:x"},
    "resource": {"case_id": "c", "arm": "noop", "state": "warm", "attempt": 0, "wall_ms": 1.0},
    "asr": {"case_id": "c", "arm": "control", "language": "en", "substitutions": 1, "deletions": 0, "insertions": 0, "reference_words": 9, "boundary_errors_seconds": [0.0] * 20},
    "failure": {"case_id": "c", "arm": "control", "attempt": 1, "normalized_failure": "http_403", "final_state": "degraded"},
    "case": {"case_id": "c", "source_family_id": "f", "split": "development", "question_class": "t", "obligations": ["answer"], "gold_count": 1,
             "gold_unavailable_reason": None, "source_metadata_hash": SHA},
    "privacy_scan": {"secret_class": "x", "artifact_path": "m.json", "observed_matches": 0, "pass": True},
}
TYPES = {"schema_version": "int", "attempt": "int", "order": "int", "correctness": "int", "completeness": "int", "citation": "int", "adherence": "int",
         "citations_checked": "int", "refused": "boolean", "reader_text_tokens": "int", "dollars": "double", "wall_ms": "double", "substitutions": "int",
         "deletions": "int", "insertions": "int", "reference_words": "int", "boundary_errors_seconds": "array<double>", "obligations": "array<string>",
         "gold_count": "int", "observed_matches": "int", "pass": "boolean"}
FAULTS = [
    ("run", {}, None), ("judgment", {}, None), ("usage", {}, None), ("resource", {}, None), ("asr", {}, None), ("failure", {}, None), ("case", {}, None), ("privacy_scan", {}, None),
    ("run", {"arm": "noop"}, "arm has invalid enum value"), ("run", {"attempt": 0}, "attempt is outside its allowed range"),
    ("run", {"result_state": "fatal"}, "non-success run requires failure_class"), ("run", {"failure_class": "http_403"}, "successful run must have null failure_class"),
    ("run", {"raw_manifest_path": "../x"}, "raw_manifest_path must be a safe relative path"), ("run", {"case_id": None}, "missing required field case_id"),
    ("run", {"created_at_utc": "2026"}, "created_at_utc does not match utc_timestamp"), ("run", {"packet_id": "Q"}, "packet_id does not match packet_id"),
    ("run", {"plan_sha256": None}, "plan_sha256 may be null only for provisional evidence"), ("run", {"plan_sha256": None, "status": "provisional"}, None),
    ("judgment", {"citation": 11}, "judgment scores must be 0 to 10"), ("judgment", {"citation": None, "refused": True}, None),
    ("usage", {"measurement_source": "guess"}, "reported usage requires a provider source"), ("usage", {"measurement_kind": "estimated"}, "estimated usage cannot claim a provider source"),
    ("usage", {"dollars": float("inf")}, "dollars is outside its allowed range"), ("usage", {"dollars": float("nan")}, "dollars is outside its allowed range"),
    ("resource", {"attempt": 1}, "noop resource requires attempt 0"), ("resource", {"arm": "control"}, "resource requires a positive attempt"),
    ("asr", {"boundary_errors_seconds": [0.0]}, "boundary_errors_seconds has too few items"), ("asr", {"reference_words": 0}, "reference_words is outside its allowed range"),
    ("case", {"obligations": []}, "obligations has too few items"), ("case", {"gold_count": None}, "null gold_evidence requires gold_unavailable_reason"),
    ("case", {"gold_unavailable_reason": "x"}, "gold_evidence excludes a reason"),
]


def test_row_rules(spark):
    for kind in CLEAN:
        faults = [(c, w) for k, c, w in FAULTS if k == kind]
        names = [*COMMON, "artifact_type", *CLEAN[kind]]
        data = [tuple({**COMMON, "artifact_type": kind, **CLEAN[kind], **change}[n] for n in names) + (i,) for i, (change, _) in enumerate(faults)]
        df = spark.createDataFrame(data, ", ".join(f"`{n}` {TYPES.get(n, 'string')}" for n in names) + ", i int")
        got = {r.i: r.rules for r in df.select("i", quality.row_rules(kind, df.columns).alias("rules")).collect()}
        for i, (change, want) in enumerate(faults):
            assert got[i] == ([want] if want else []), (kind, change)


@pytest.mark.parametrize("block", [3, 1000])
def test_access_log(spark, monkeypatch, block):
    monkeypatch.setattr(keyed, "BLOCK_ROWS", block)
    events = spark.createDataFrame([(1, i, 100 + i, "authorized_open" if i < 7 else "exposure") for i in range(8)], "log_id int, idx long, item_id long, action string")
    log = audit.append_records(events)
    first = log.orderBy("idx").first()
    body = '{"action":"authorized_open","item_id":100,"previous_hash":"' + "0" * 64 + '","sequence":1}'
    assert first.record_hash == hashlib.sha256(body.encode()).hexdigest()
    assert audit.log_violations(log).count() == 0

    def rules(changed):
        return {(r.idx, r.rule) for r in audit.log_violations(changed).collect()}

    assert rules(log.withColumn("item_id", F.when(F.col("idx") == 3, 5).otherwise(F.col("item_id")))) == {(3, "record_hash does not verify")}
    assert rules(log.withColumn("sequence", F.when(F.col("idx") == 3, 9).otherwise(F.col("sequence")))) == {(3, "non-append-only sequence"), (3, "record_hash does not verify")}
    cut = {(4, "previous_hash does not chain"), (3, "record_hash does not verify")}
    assert rules(log.withColumn("record_hash", F.when(F.col("idx") == 3, SHA).otherwise(F.col("record_hash")))) == cut
    early = audit.append_records(events.withColumn("action", F.when(F.col("idx") == 5, "exposure").otherwise(F.col("action"))))
    assert rules(early) == {(6, "reuses a spent cohort"), (7, "reuses a spent cohort")}


def test_inventory_and_restore(spark, tmp_path):
    from timesift.sources.readers import inventory
    from timesift.sources.writers import restore

    files = spark.createDataFrame([("a.txt", bytearray(b"one")), ("b.txt", bytearray(b"two"))], "path string, content binary")
    listed = inventory(files).withColumn("media_included", F.lit(False))
    assert quality.inventory_violations(listed, inventory(files)).count() == 0
    bent = listed.withColumn("sha256", F.when(F.col("path") == "a.txt", SHA).otherwise(F.col("sha256")))
    assert [tuple(r) for r in quality.inventory_violations(bent, inventory(files)).collect()] == [("a.txt", "checksum mismatch")]
    with pytest.raises(ValueError):
        restore(bent, files, str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()
    restore(listed, files, str(tmp_path / "yes"))
    assert spark.read.parquet(str(tmp_path / "yes")).count() == 2


def test_arm_diff_and_leaks(spark):
    rows = spark.createDataFrame([(1, a, "f", v) for a, vs in (("control", "xyx"), ("candidate", "xxy")) for v in vs] + [(2, "control", "f", "x"), (2, "candidate", "f", "y")],
                                 "case_id int, arm string, field string, value string")
    assert [tuple(r) for r in quality.arm_diff(rows).collect()] == [(2, "f")]
    cases = spark.createDataFrame([(1, "development"), (1, "confirmatory"), (2, "development")], "family_id int, split string")
    assert [r.family_id for r in quality.split_leakage(cases).collect()] == [1]


def test_registry(spark):
    fam = spark.createDataFrame([(f"f-{i}", "confirmatory", "c") for i in range(5)] + [("d-1", "development", "c")], "family_id string, split string, question_class string")
    ids = spark.createDataFrame([(f, f"i-{f}", hashlib.sha256(f.encode()).hexdigest()) for f in [f"f-{i}" for i in range(5)] + ["d-1"]], "family_id string, identity_id string, identity_sha256 string")
    assert quality.registry_violations(fam, ids).count() == 0
    assert {r.rule for r in quality.registry_violations(fam.where("family_id <> 'f-0'"), ids).collect()} == {"underpowered confirmatory cohort"}
    twice = ids.unionByName(ids.where("family_id = 'd-1'"))
    assert {r.rule for r in quality.registry_violations(fam, twice).collect()} == {"duplicate identity alias", "duplicate identity hash"}
    doers = spark.createDataFrame([("runner", "k")], "actor_id string, custodian_id string")
    held = ids.withColumn("custodian_id", F.lit("k"))
    assert quality.visible_rows(held, fam, doers, "runner").count() == 1 and quality.visible_rows(held, fam, doers, "other").count() == 0


def test_a_log_is_checked_from_its_seal_and_tail(spark):
    events = spark.createDataFrame([(log, i, 7 * i, "exposure" if (log, i) == (2, 3) else "authorized_open") for log in (1, 2) for i in range(9)],
                                   "log_id long, idx long, item_id long, action string")
    log = audit.append_records(events).orderBy("log_id", "idx").collect()
    log = spark.createDataFrame(log, "log_id long, idx long, item_id long, action string, sequence long, previous_hash string, record_hash string")
    sealed, tail = audit.seals(log.where("idx < 6")), log.where("idx >= 6")

    def found(seal, rows):
        return sorted((r.log_id, r.idx, r.rule) for r in audit.tail_violations(seal, rows).collect())

    # The tail of log 2 comes after an exposure under the seal, as in the whole log.
    spent = [(2, i, "reuses a spent cohort") for i in (6, 7, 8)]
    assert found(sealed, tail) == spent == [x for x in sorted((r.log_id, r.idx, r.rule) for r in audit.log_violations(log).collect()) if x[1] >= 6]
    assert found(sealed, tail.limit(0)) == []
    assert (1, 7, "does not follow the seal") in found(sealed, tail.where("idx > 6")) and (1, 7, "previous_hash does not chain") in found(sealed, tail.where("idx > 6"))
    assert {(1, 6, "seal does not verify"), (2, 6, "seal does not verify")} <= set(found(sealed.withColumn("exposures", F.lit(9).cast("long")), tail))
    assert found(sealed.limit(0), log.where("log_id = 1")) == []
    assert (1, 6, "does not follow the seal") in found(sealed.limit(0), tail)
