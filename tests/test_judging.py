"""The repair of rejected chunks, against a judge that is asked chunk by chunk."""

import json
import random

from steploom.operators import judging

SCHEMA = "item string, arm string, chunk int, attempt int, wanted array<string>, payload string, tokens int"


def row(step, **more):
    return {"step_id": step, "behavior": "linear", "behavior_confidence": 0.5, "verdict": "sound", "validity_confidence": 1, "error_type": None, "rationale": "r"} | more


def said(*rows):
    return json.dumps({"steps": list(rows)})


def asked(chunks):
    """One call after the other, up to the first chunk that fails twice: chunks are (wanted, said at first, said after the repair), with tokens."""
    out = {"chunks": len(chunks), "calls": 0, "repairs": 0, "truncations": 0, "tokens": 0, "n_rows": 0, "ok": True, "at": None}

    def fine(wanted, payload):
        try:
            rows = json.loads(payload)["steps"]
        except (TypeError, ValueError, KeyError):
            return None
        good = sorted(r["step_id"] for r in rows) == sorted(wanted) and all((r["verdict"] == "unsound") == (r["error_type"] is not None) and 0 <= r["validity_confidence"] <= 1 and r["behavior"] == "linear" for r in rows)
        return rows if good else None

    for i, (wanted, *attempts) in enumerate(chunks, 1):
        for k, (payload, tokens) in enumerate(attempts):
            out["calls"] += 1
            out["repairs"] += k
            rows = fine(wanted, payload)
            if rows is not None:
                out["truncations"] += sum(len(r["rationale"]) > 200 for r in rows)
                out["tokens"] += tokens
                out["n_rows"] += len(rows)
                break
        else:
            return out | {"ok": False, "at": i, "truncations": 0, "tokens": 0, "n_rows": 0}
    return out


def test_repairs_and_counters_as_a_judge_that_is_asked_in_turn(spark):
    rng = random.Random(5)
    traces, rows = {}, []
    for t in range(60):
        item, arm, chunks = f"i{t // 3}", [None, "react", "direct"][t % 3], []
        for k in range(rng.randrange(1, 5)):
            wanted = [f"s{k}.{j}" for j in range(rng.randrange(1, 4))]

            def payload():
                good = [row(s, rationale="x" * rng.choice([3, 400])) for s in wanted]
                return rng.choice([said(*good), said(*good[::-1]), "```json\n" + said(*good) + "\n```"] * 3 + [said(*good[1:]), said(*good, row("other")), said(*good, good[0]), "none", None, said(row(wanted[0], verdict="unsound"), *good[1:]), said(row(wanted[0], validity_confidence=1.5), *good[1:])])

            attempts = [(payload(), rng.randrange(100)) for _ in range(2)]
            chunks.append((wanted, *[((p or "").removeprefix("```json\n").removesuffix("\n```") or p, n) for p, n in attempts]))
            rows += [(item, arm, k * 7, a, wanted, p, n) for a, (p, n) in enumerate(attempts)] + [(item, arm, k * 7, 2, wanted, said(*map(row, wanted)), 5)]
        traces[item, arm] = asked(chunks)
    rng.shuffle(rows)
    got = {(r.item, r.arm): r for r in judging.classified(spark.createDataFrame(rows + rows[:20], SCHEMA), ["item", "arm"]).collect()}
    assert set(got) == set(traces)
    for key, want in traces.items():
        r = got[key]
        assert {k: r[k] for k in ("chunks", "calls", "repairs", "truncations", "tokens", "n_rows", "ok")} == {k: v for k, v in want.items() if k != "at"}, key
        assert (r.degraded is None) == want["ok"]
        if r.degraded:
            assert r.degraded.reason == "classifier_parse_failure" and r.degraded.affects == ["behavior", "validity"] and r.degraded.detail.startswith(f"chunk {want['at']}/{want['chunks']}: ")
    assert sum(not w["ok"] for w in traces.values()) > 3 and sum(w["repairs"] for w in traces.values()) > 5


def test_what_the_repair_is_told(spark):
    cases = [("no json", "no JSON object with steps"), (said(row("a")), "step_id mismatch: 1 missing, 0 unknown"), (said(row("a"), row("b"), row("c")), "step_id mismatch: 0 missing, 1 unknown"),
             (said(row("a", behavior="musing"), row("b", verdict="unsound")), "a: behavior; b: error_type"), (said(row("a", behavior="x", verdict="y", validity_confidence=2, error_type="z"), row("b", behavior="x")), "a: behavior; a: verdict; a: confidence; a: error_type (and 2 more)")]
    rows = [(f"t{i}", None, 0, 0, ["a", "b"], p, 1) for i, (p, _) in enumerate(cases)]  # no second attempt was recorded
    chunks = {r.item: r for r in judging.repaired(spark.createDataFrame(rows, SCHEMA), ["item", "arm"]).collect()}
    for i, (_, want) in enumerate(cases):
        r = chunks[f"t{i}"]
        assert r.told == want and r.ok is False and r.repair and r.calls == 2 and r.rows is None


def test_no_chunks(spark):
    assert judging.classified(spark.createDataFrame([], SCHEMA), ["item", "arm"]).count() == 0
