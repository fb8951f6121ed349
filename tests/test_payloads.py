"""Nested payloads against a plain walk, and the rules one by one."""

import json
import random

from timesift.operators import payloads

SCHEMA = "payload_id long, payload string"


def plain_paths(value, path="payload"):
    yield path
    if isinstance(value, dict):
        for key, item in value.items():
            yield from plain_paths(item, f"{path}.{key}")
    elif isinstance(value, list):
        for i, item in enumerate(value):
            yield from plain_paths(item, f"{path}[{i}]")


def grown(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([None, True, 3, 2.5, "text", "", [], {}])
    if rng.random() < 0.5:
        return [grown(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {f"f{i}": grown(rng, depth - 1) for i in range(rng.randrange(4))}


def test_every_node_is_met_once(spark):
    rng = random.Random(3)
    trees = [grown(rng, d) for d in (0, 1, 3, 6, 6, 6)]
    rows = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], SCHEMA)
    got = payloads.nodes(rows.selectExpr("payload_id", "parse_json(payload) AS payload")).collect()
    assert sorted((r.payload_id, r.path) for r in got) == sorted((i, p) for i, t in enumerate(trees) for p in plain_paths(t))


def test_rules(spark, rows):
    cases = [
        {"a": [{"deep": {"api_key": 1}}]},
        {"image": "x", "Frames": [], "crop": {"w": 1}, "audio": 3},
        ["cookie = abc", "plain", "nul\u0000"],
        ["/rooted", "~/mine", "C:\\x", "C:x", "0:04", "\\\\host", "FILE:x", "a/b"],
        {"u": "https://a.b/c?d", "v": "https://a.b/c", "w": "why?"},
        "password: hunter",
    ]
    data = [(i, json.dumps(c)) for i, c in enumerate(cases)] + [(90, "{no json"), (91, None), (92, '{"a":1,"a":2}'), (93, "{}")]
    data.append((1, json.dumps(cases[1])))
    got = rows.got(payloads.payload_violations(spark.createDataFrame(data, SCHEMA)), "payload_id", "path", "rule")
    want = [(0, "payload.a[0].deep.api_key", "secret-like field"),
            *[(1, f"payload.{k}", "persisted media") for k in ("image", "crop")] * 2,
            (2, "payload[0]", "secret-like text"), (2, "payload[2]", "secret-like text"),
            *[(3, f"payload[{i}]", "absolute private path") for i in (0, 1, 2, 3, 5, 6)],
            (4, "payload.u", "non-canonical URL"), (5, "payload", "secret-like text"),
            (90, "payload", "is not JSON"), (92, "payload", "is not JSON")]
    assert got == sorted(want, key=repr)
    assert payloads.payload_violations(spark.createDataFrame([], SCHEMA)).count() == 0
