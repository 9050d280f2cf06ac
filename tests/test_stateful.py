"""Alerts and recent rows over started streams of several batches, with late rows, a restart and odd rows."""

import random
from collections import defaultdict

import pytest

from factspark.streaming import stateful as S

RULES = [S.Rule("level", for_s=20), S.Rule("burn", for_s=10, limit=0.4, long_s=60, short_s=20)]


def write(spark, path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "key long, t long, bad long, total long").coalesce(1).write.parquet(f"{path}/{i}")


def stream(spark, path, schema="key long, t long, bad long, total long"):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def by_hand(rows):
    """Runs of each key and rule, sample by sample."""
    out, keys = set(), defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for key, t, bad, total in rows:
        if t is not None:
            keys[key][t][0] += bad or 0
            keys[key][t][1] += total or 0
    for key, samples in keys.items():
        at = sorted(samples)
        for rule in RULES:
            run = None
            for i, t in enumerate(at):
                if rule.long_s:
                    hit = True
                    for w in (rule.long_s, rule.short_s):
                        inside = [s for s in at[: i + 1] if s >= t - w][1:]
                        n, b = sum(samples[s][1] for s in inside), sum(samples[s][0] for s in inside)
                        hit &= n > 0 and b > rule.limit * n
                else:
                    hit = samples[t][0] > 0
                if not hit:
                    run = None
                    continue
                if run is None:
                    run = [key, rule.name, t, t, 0, None]
                else:
                    out.discard(tuple(run))
                run[3], run[4] = t, run[4] + 1
                if run[5] is None and t - run[2] >= rule.for_s:
                    run[5] = t
                out.add(tuple(run))
    return out


def found(log):
    return {(r.key, r.rule, r["first"], r["last"], r.length, r.fired_at) for r in S.alerts(log).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_alerts_with_late_rows_and_a_restart(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(k, t, int(rng.random() < (0.8 if (t // 70) % 2 else 0.2)), 1) for k in (1, 2, None) for t in sorted(rng.sample(range(400), 90))]
    shuffled = sorted(rows, key=lambda r: r[1] + rng.randint(0, 25))  # late by 25 seconds at most
    batches = [shuffled[i : i + 60] for i in range(0, len(shuffled), 60)]
    write(spark, f"{tmp_path}/in", batches[:2])
    run = lambda: S.logged(S.alert_changes(stream(spark, f"{tmp_path}/in"), RULES, late=30), f"{tmp_path}/log", f"{tmp_path}/c")
    assert found(run()) == by_hand([r for b in batches[:2] for r in b])
    for i, b in enumerate(batches[2:], 2):
        spark.createDataFrame(b, "key long, t long, bad long, total long").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    assert found(run()) == by_hand(rows)  # goes on from its state


def test_too_late_rows_and_nulls_are_left_out(spark, tmp_path):
    write(spark, f"{tmp_path}/in", [[(1, 100, 1, 1), (1, 150, 1, 1), (1, None, 1, 1)], [(1, 90, 0, 1), (1, 160, None, None)]])
    log = S.logged(S.alert_changes(stream(spark, f"{tmp_path}/in"), RULES[:1], late=10), f"{tmp_path}/log", f"{tmp_path}/c")
    assert found(log) == {(1, "level", 100, 150, 2, 150)}


def test_a_late_row_takes_a_run_back(spark, tmp_path):
    write(spark, f"{tmp_path}/in", [[(1, 100, 1, 1)], [(1, 95, 1, 1)], [(1, 98, 0, 1), (1, 97, 1, 1)]])
    log = S.logged(S.alert_changes(stream(spark, f"{tmp_path}/in"), RULES[:1], late=60), f"{tmp_path}/log", f"{tmp_path}/c")
    assert found(log) == {(1, "level", 95, 97, 2, None), (1, "level", 100, 100, 1, None)}


def test_recent_rows_are_the_last(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.randint(0, 50), i) for i in range(300)] + [(3, None, 1), (3, 1, None), (4, 7, 7)]
    for i in range(3):
        spark.createDataFrame(rows[i::3], "key long, at long, id long").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    log = S.logged(S.recent_changes(stream(spark, f"{tmp_path}/in", "key long, at long, id long"), 4), f"{tmp_path}/log", f"{tmp_path}/c")
    want = set()
    for key in (1, 2, None, 4):
        own = sorted(((a, i) for k, a, i in rows if k == key and a is not None and i is not None), reverse=True)[:4]
        want |= {(key, n + 1, a, i) for n, (a, i) in enumerate(own)}
    assert {tuple(r) for r in S.recent(log).collect()} == want
