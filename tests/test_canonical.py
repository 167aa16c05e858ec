"""Canonical JSON against the standard library's, and reuse of stages against full runs."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipweave.functions import canonical as cj
from clipweave.operators.reuse import Conflict, StageStore, fingerprints, reuse

_DEEP = T.StructType().add("y", "string").add("x", T.ArrayType(T.IntegerType())).add("b", T.StructType().add("q", "double"))
KIND = T.StructType().add("z", "string").add("a", "long").add("ratio", "double").add("flag", "boolean").add('k"é', "float").add("m", T.MapType(T.StringType(), T.ArrayType(T.DoubleType()))).add("deep", T.ArrayType(_DEEP))
NUMBERS = [0.0, -0.0, 1.0, -1.5, 0.1, 1 / 3, 1e15, 123456789012345680.0, 9999999999999998.0, 1e16, 1e-4, 9.9e-5, 1e-5, 5e-324, 1.7976931348623157e308, 2.0**70, 1e22, 1e23, 0.30000000000000004, 100.0, 1230000.0, 5.684341886080802e-14, 2e-3, float("nan"), float("inf"), float("-inf")]
TEXTS = ["", "plain", 'q"\\/', "\n\r\t\b\f\x00\x1f\x7f", "é ü ß", "漢字", "\U0001f600 a \U00010000", " ퟿￿", " "]


def rows(seed, n):
    rnd = random.Random(seed)
    number = lambda: rnd.choice([rnd.choice(NUMBERS), rnd.uniform(-1e3, 1e3), rnd.random() * 10.0 ** rnd.randint(-20, 20)])
    text = lambda: rnd.choice([None, rnd.choice(TEXTS), rnd.choice(TEXTS) + rnd.choice(TEXTS)])
    maybe = lambda v: v if rnd.random() < 0.8 else None
    out = []
    for _ in range(n):
        deep = [maybe((text(), maybe([rnd.randint(-9, 9) for _ in range(rnd.randint(0, 3))]), maybe((maybe(number()),)))) for _ in range(rnd.randint(0, 3))]
        out.append((text(), maybe(rnd.randint(-(2**63), 2**63 - 1)), maybe(number()), maybe(rnd.random() < 0.5), maybe(float(rnd.randint(-99, 99)) / 4), maybe({rnd.choice(TEXTS) + str(k): maybe([maybe(number())]) for k in range(3)}), maybe(deep)))
    return out


def as_python(v, kind, omit):
    if v is None:
        return None
    if isinstance(kind, T.StructType):
        fields = {f.name: as_python(v[k], f.dataType, omit) for k, f in enumerate(kind.fields)}
        return {k: x for k, x in fields.items() if x is not None or not omit}
    if isinstance(kind, T.ArrayType):
        return [as_python(x, kind.elementType, omit) for x in v]
    if isinstance(kind, T.MapType):
        return {k: as_python(x, kind.valueType, omit) for k, x in v.items()}
    return v


@pytest.mark.parametrize(("ascii", "omit"), [(False, False), (True, False), (True, True)])
def test_equal_to_the_standard_library(spark, ascii, omit):
    data = rows(4, 150) + [(None,) * 7]
    d = spark.createDataFrame([(k, r) for k, r in enumerate(data)], T.StructType().add("k", "integer").add("r", KIND))
    got = {r.k: r.j for r in d.select("k", cj.canonical_json(F.col("r"), KIND, ascii, omit).alias("j")).collect()}
    for k, r in enumerate(data):
        assert got[k] == json.dumps(as_python(r, KIND, omit), sort_keys=True, separators=(",", ":"), ensure_ascii=ascii)


def test_numbers_and_refusals(spark):
    rnd = random.Random(9)
    values = NUMBERS + [rnd.random() * 10.0 ** rnd.randint(-300, 300) for _ in range(2000)] + [float(rnd.randint(0, 2**60)) for _ in range(300)] + [k / 1000 for k in range(300)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", cj.json_number(F.col("v")).alias("j")).collect()
    assert all(r.j == json.dumps(r.v) for r in got)
    for kind in (T.DateType(), T.BinaryType(), T.DecimalType(9, 2), T.MapType(T.IntegerType(), T.StringType())):
        with pytest.raises(TypeError):
            cj.canonical_json(F.col("v"), kind)


def test_hashes(spark):
    d = spark.createDataFrame([((3, 0.5, "x", "old"), "src", [("cut", 4, None)], 77, ["00ff", "a1"]), ((3, 0.5, "x", "new"), "src", [], 0, [])], "c struct<b:int,a:double,n:string,config_hash:string>, s string, ops array<struct<kind:string,start:int,long:int>>, size bigint, chunks array<string>")
    kind = d.schema["c"].dataType
    got = d.select(cj.config_digest(F.col("c"), kind).alias("c"), cj.revision_hash(F.col("s"), F.col("ops"), d.schema["ops"].dataType, "p", "r").alias("r"), cj.identity_hash(F.col("size"), F.col("chunks")).alias("i")).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert {r.c for r in got} == {"sha256:" + sha(json.dumps({"a": 0.5, "b": 3, "n": "x"}, sort_keys=True, separators=(",", ":")).encode())}
    recipe = json.dumps({"schema_version": 1, "ops": [{"kind": "cut", "start": 4}]}, sort_keys=True, separators=(",", ":"))
    assert [r.r for r in got] == [sha(f"p\nsrc\nr\n{recipe}".encode()), None]
    assert [r.i for r in got] == [sha((77).to_bytes(8, "big") + bytes.fromhex("00ffa1")), sha(bytes(8))]


def stage(r):
    return r.where("v > 0").groupBy("rec").agg(F.sum("v").alias("s"), F.count("*").alias("n"))


def test_reuse_computes_what_changed(spark, tmp_path):
    store = StageStore(spark, f"file://{tmp_path}/store")
    data = [(f"r{k % 7}", k, float(k)) for k in range(70)] + [("empty", 1, -1.0), (None, 1, 5.0)]
    frame = lambda x: spark.createDataFrame(x, "rec string, k int, v double")
    calls = []

    def seen(r):
        calls.append(sorted(x[0] for x in r.select("rec").distinct().collect()))
        return stage(r)

    full = lambda x: sorted(map(tuple, stage(frame(x).where("rec IS NOT NULL")).collect()))
    run = lambda x, **o: (lambda out: (sorted(map(tuple, out[0].collect())), out[1]))(reuse(store, frame(x).repartition(5), "rec", seen, **o))
    assert run(data) == (full(data), {"computed": 8, "kept": 0, "gone": 0})
    assert run(list(reversed(data))) == (full(data), {"computed": 0, "kept": 8, "gone": 0}) and store.version() == 1
    changed = [(r, k, v + 1 if r == "r3" and k == 3 else v) for r, k, v in data if r != "r5"]
    assert run(changed) == (full(changed), {"computed": 1, "kept": 6, "gone": 1}) and calls[-1] == ["r3"]
    assert len(list((tmp_path / "store" / "data").iterdir())) == 2
    assert run(changed, settings="other")[1]["computed"] == 7 and len(calls[-1]) == 7
    assert run(data)[0] == full(data)


def test_two_runs_can_not_publish_one_manifest(spark, tmp_path):
    store = StageStore(spark, f"file://{tmp_path}/store")
    rows_ = spark.createDataFrame([("a", 1.0)], "rec string, v double")
    reuse(store, rows_, "rec", stage)
    entries = fingerprints(rows_, "rec").withColumn("run", F.lit("x"))
    with pytest.raises(Conflict):
        store.publish(entries, 0)
    assert store.version() == 1 and store.results().count() == 1


def test_fingerprints_see_bags(spark):
    f = lambda x, s="": {r.rec: r.fingerprint for r in fingerprints(spark.createDataFrame(x, "rec string, v string"), "rec", s).collect()}
    one = f([("a", "x"), ("a", "y"), ("b", None)])
    assert one == f([("a", "y"), ("b", None), ("a", "x")]) and one["a"] != f([("a", "x"), ("a", "y"), ("a", "y")])["a"]
    assert one["b"] != f([("b", "")])["b"] and one["b"] != f([("b", None)], "s")["b"]
