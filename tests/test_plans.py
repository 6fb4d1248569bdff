import json
import os

import pytest

from flowmill.functions.numeric import truncated
from flowmill.plans.protocols import load_splits, prepare_family
from flowmill.sources import metrics


def _cic(folder, day, part, start, n):
    lines = ["Flow Duration, Total ,Label"]
    lines += [f"{start + i},{(start + i) % 7}.5,{'BENIGN' if i % 3 else 'DDoS'}" for i in range(n)]
    (folder / f"{day}-{part}.csv").write_text("\n".join(lines) + "\n")
    return str(folder / f"{day}-{part}.csv")


def test_cic_default_and_day_holdout(spark, tmp_path):
    paths = [
        _cic(tmp_path, "Monday", "all", 0, 40), _cic(tmp_path, "Thursday", "Morning", 100, 20),
        _cic(tmp_path, "Thursday", "Afternoon", 200, 20), _cic(tmp_path, "Friday", "all", 300, 20),
        _cic(tmp_path, "Extra", "all", 400, 10),
    ]
    flat = load_splits(spark, "cic", paths)
    rows = sorted(flat.collect(), key=lambda r: r.row_idx)
    # alphabetical: Extra, Friday, Monday, Thursday-Afternoon, Thursday-Morning
    assert [r["Flow Duration"] for r in rows][:11] == [400 + i for i in range(10)] + [300]
    assert rows[-1]["Flow Duration"] == 119
    n = len(rows)
    assert sum(r.split == "train" for r in rows) == truncated(n, 0.7) and n == 110

    held = load_splits(spark, "cic", paths, policy="day_holdout")
    by = {}
    for r in sorted(held.collect(), key=lambda r: r.split_idx):
        by.setdefault(r.split, []).append(r["Flow Duration"])
    assert by["train"] == list(range(40)) and by["test"] == [300 + i for i in range(20)]
    assert by["val"] == [100 + i for i in range(20)] + [200 + i for i in range(20)]

    p = prepare_family(held, "cic", seq_len=4)
    assert p.features == ["Flow Duration", "Total"]
    assert {r.split: r.windows for r in p.info().collect()} == {"train": 37, "val": 37, "test": 17}


def test_unsw_protocols(spark, tmp_path):
    header = "id,dur,proto,attack_cat,label\n"
    for name, start, n in (("train", 1, 60), ("test", 1000, 20)):
        body = "".join(
            f"{start + i},{i * 0.25},{'tcp' if i % 2 else 'udp'},{'Normal' if i % 4 else 'DoS'},{int(i % 4 == 0)}\n" for i in range(n)
        )
        (tmp_path / f"{name}.csv").write_text(header + body)
    rows = load_splits(spark, "unsw", [str(tmp_path / "train.csv"), str(tmp_path / "test.csv")])
    sizes = {r.split: r["count"] for r in rows.groupBy("split").count().collect()}
    assert sizes == {"train": 51, "val": 9, "test": 20}
    want = {
        "clean": ["dur", "proto"], "attack_cat": ["dur", "proto", "attack_cat"],
        "id": ["id", "dur", "proto"], "both": ["id", "dur", "proto", "attack_cat"],
    }
    for protocol, features in want.items():
        assert prepare_family(rows, "unsw", protocol, seq_len=4).features == features
    with pytest.raises(ValueError):
        prepare_family(rows, "unsw", "other")
    with pytest.raises(ValueError):
        load_splits(spark, "unsw", [], policy="day_holdout")


def test_nsl_files(spark, tmp_path):
    for name, n in (("train", 40), ("test", 15)):
        lines = [
            ",".join([str(i), "tcp", "http", "SF", *["1"] * 37, "normal." if i % 2 else "neptune.", "21"]) for i in range(n)
        ]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    rows = load_splits(spark, "nsl", [str(tmp_path / "train"), str(tmp_path / "test")])
    p = prepare_family(rows, "nsl", seq_len=4, scaling="minmax")
    assert len(p.features) == 41 and "difficulty" not in p.features
    assert {r.y: r["count"] for r in p.df.groupBy("y").count().collect()} == {1: 28, 0: 27}


def test_efficiency_records(spark, tmp_path):
    docs = {
        "main/d/a/seed_1": {"params": 5, "inference": {"batch_1": {"ms": 1.5, "rate": 10.0}, "macs": 7}},
        "main/d/gbt/seed_1": {"trees": 30},
    }
    for rel, doc in docs.items():
        os.makedirs(tmp_path / rel)
        (tmp_path / rel / "efficiency.json").write_text(json.dumps(doc))
    got = {r.relative_path: r for r in metrics.read_efficiency(spark, str(tmp_path)).collect()}
    a = got["main/d/a/seed_1/efficiency.json"]
    assert (a.inference_batch_1_ms, a.inference_macs, a.family) == (1.5, 7, "main")
    assert got["main/d/gbt/seed_1/efficiency.json"].trees == 30


def test_write_tables(spark, tmp_path):
    metrics.write_tables({"a": spark.range(2), "b": spark.range(3)}, str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "b")).count() == 3
