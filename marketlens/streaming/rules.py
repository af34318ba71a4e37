"""Row-by-row definitions of the alarm rules, for one key in time order.

Each factory returns ``step(state, row) -> (state, outputs)`` with a JSON-able state. Streams keep the
state between micro-batches; the tests use the same definitions as brute force for the batch forms.
"""

from __future__ import annotations


def level_cross(levels, rearm_pct=2.0, cooldown=300, max_gap=90):
    """Each level is a small memory: ``ready`` (below it since the last crossing) and ``quiet_until``.

    A price is low (at or under the re-arm line), high (at or over the level) or in between. Low makes ready, high
    uses it up, and a use outside the quiet time is an alarm.
    """
    lines = [(level, level * (1 - rearm_pct / 100)) for level in levels]

    def step(s, r):
        now, price = r["ts"], r["price"]
        if s is None or now - s["ts"] > max_gap:
            return {"ts": now, "ready": [price < level for level, _ in lines], "quiet_until": [None] * len(lines)}, []
        high = [price >= level for level, _ in lines]
        crossed = [h and was for h, was in zip(high, s["ready"])]
        loud = [c and (q is None or now >= q) for c, q in zip(crossed, s["quiet_until"])]
        ready = [price <= low or (was and not h) for (_, low), was, h in zip(lines, s["ready"], high)]
        quiet = [now + cooldown if x else q for x, q in zip(loud, s["quiet_until"])]
        fired = [{"id": r["id"], "ts": now, "level": level, "price": price} for (level, _), x in zip(lines, loud) if x]
        return {"ts": now, "ready": ready, "quiet_until": quiet}, fired

    return step


def one_shot_targets(targets, strict=False):
    def step(s, r):
        s, out = s or {"hit": []}, []
        for t in targets:
            v = r["cap"]
            if v is not None and v == v and t not in s["hit"] and (v > t if strict else v >= t):
                s["hit"].append(t)
                out.append({"id": r["id"], "ts": r["ts"], "target": float(t), "cap": v})
        return s, out

    return step


def trailing_reference(factor=1.10):
    def step(s, r):
        if s is None:
            return {"ref": r["price"]}, []
        if r["price"] >= s["ref"] * factor:
            return {"ref": r["price"]}, [{"ts": r["ts"], "price": r["price"]}]
        return s, []

    return step


def movement_alarm(threshold, window=900, tolerance=90, max_gap=120, cooldown=1800):
    def step(s, r):
        s = s or {"rows": [], "sent": None}
        now = r["ts"]
        s["rows"] = [x for x in s["rows"] if x[0] >= now - window - tolerance] + [[now, r["price"]]]
        base = [i for i, x in enumerate(s["rows"]) if x[0] <= now - window]
        if not base:
            return s, []
        path = s["rows"][base[-1]:]
        if path[0][1] == 0 or any(z[0] - a[0] > max_gap for a, z in zip(path, path[1:])):
            return s, []
        pct = (r["price"] / path[0][1] - 1) * 100
        quiet = s["sent"] is not None and now - s["sent"] < cooldown
        if abs(pct) + 1e-9 < threshold(r) or quiet:
            return s, []
        s["sent"] = now
        return s, [{"id": r["id"], "ts": now, "move_pct": round(pct, 6)}]

    return step


def movement_alarm_with_delivery(threshold, window=900, tolerance=90, max_gap=120, cooldown=1800, retry=60):
    """``movement_alarm`` whose message may fail: rows with ``attempt`` tell how the message of that row's id went (``ok``).

    A delivered message silences for ``cooldown`` from its own time; an attempt, whatever became of it, for ``retry``.
    """

    def step(s, r):
        s = s or {"rows": [], "sent": None, "tried": None, "id": None}
        now = r["ts"]
        if r["attempt"] is not None:
            if r["ok"] and r["attempt"] == s["id"]:
                s["sent"] = s["tried"]
            return s, []
        s["rows"] = [x for x in s["rows"] if x[0] >= now - window - tolerance] + [[now, r["price"]]]
        base = [i for i, x in enumerate(s["rows"]) if x[0] <= now - window]
        path = s["rows"][base[-1]:] if base else []
        if not path or path[0][1] == 0 or any(z[0] - a[0] > max_gap for a, z in zip(path, path[1:])):
            return s, []
        pct = (r["price"] / path[0][1] - 1) * 100
        waits = any(s[k] is not None and now - s[k] < n for k, n in (("sent", cooldown), ("tried", retry)))
        if abs(pct) + 1e-9 < threshold(r) or waits:
            return s, []
        s["tried"], s["id"] = now, r["id"]
        return s, [{"id": r["id"], "ts": now, "move_pct": round(pct, 6)}]

    return step


def incident_transitions(retry=300, incidents=("paused", "stalled", "unhealthy", "unavailable")):
    """What was told last is ``told``; a message is due when there is news, and waits for the retry time.

    News is an incident other than the one told, or the first good status after one was told.
    """
    def step(s, r):
        told, free_at = s or (None, None)
        bad = r["status"] in incidents
        news = r["status"] != told if bad else told is not None and r["status"] == "collecting"
        blocked = free_at is not None and r["ts"] < free_at
        delivery = "idle" if not news else "retry_wait" if blocked else "sent"
        if delivery == "sent":
            told, free_at = r["status"] if bad else None, r["ts"] + retry
        return [told, free_at], [{"id": r["id"], "delivery": delivery}]

    return step


def feed_health(outage_after=60):
    def step(s, r):
        if r["ok"]:
            out = [{"ts": r["ts"], "since": s["since"], "notice": "recovered"}] if s and s["warned"] else []
            return {"since": None, "warned": False}, out
        s = s or {"since": None, "warned": False}
        s["since"] = r["ts"] if s["since"] is None else s["since"]
        if not s["warned"] and r["ts"] - s["since"] >= outage_after:
            s["warned"] = True
            return s, [{"ts": r["ts"], "since": s["since"], "notice": "outage"}]
        return s, []

    return step


def spaced(min_sep):
    def step(s, r):
        if s is None or r["ts"] >= s["last"] + min_sep:
            return {"last": r["ts"]}, [{"ts": r["ts"]}]
        return s, []

    return step


def sequence_guard(arrival="id"):
    def step(s, r):
        if s is not None and r["_ts"] <= s["ts"]:
            why = "clock_or_duplicate"
        elif s is not None and r["_source"] < s["source"]:
            why = "source_time_reversed"
        else:
            why, s = "accepted", {"ts": r["_ts"], "source": r["_source"]}
        return s, [{arrival: r[arrival], "sequence_reason": why}]

    return step


def quiet(inner, cooldown):
    """What ``inner`` gives, but after each output of a key nothing for ``cooldown`` seconds."""
    def step(s, r):
        inside, free_at = s or (None, None)
        inside, out = inner(inside, r)
        if not out or (free_at is not None and r["ts"] < free_at):
            return [inside, free_at], []
        return [inside, r["ts"] + cooldown], out

    return step


def gap_baseline(lowest, max_gap=90):
    """Rows that open a series (start or gap) at or above ``lowest``."""
    def step(s, r):
        opens = s is None or r["ts"] - s > max_gap
        return r["ts"], [{"id": r["id"], "ts": r["ts"], "price": r["price"]}] if opens and r["price"] >= lowest else []

    return step


def against_reference(judge, cols, oldest=360, newest=300, max_gap=90):
    """``judge(row, reference)`` for every row with a reference: the latest row from ``oldest`` to ``newest`` seconds
    before it on the same gap-free stretch. The memory holds the rows of ``oldest`` seconds and is emptied by a gap."""
    def step(s, r):
        rows = [] if s and r["ts"] - s[-1][0] > max_gap else s or []
        rows = [x for x in rows if x[0] >= r["ts"] - oldest]
        fit = [x for x in rows if x[0] <= r["ts"] - newest]
        out = judge(r, dict(zip(cols, fit[-1][1:]))) if fit else None
        return [*rows, [r["ts"], *(r[c] for c in cols)]], [] if out is None else [{"id": r["id"], "ts": r["ts"], **out}]

    return step


def liquidity_drop(floor=0.85, **reach):
    def judge(r, ref):
        ratio = r["liq"] / ref["liq"] if ref["liq"] else None
        return {"liq_ratio": ratio} if ratio is not None and ratio <= floor else None

    return against_reference(judge, ("liq",), **reach)


def activity_watch(lowest_level, min_volume=100, **reach):
    def judge(r, ref):
        total = r["buys_m5"] + r["sells_m5"]
        busy = ref["vol_m5"] >= min_volume and r["vol_m5"] >= 2 * ref["vol_m5"] and total >= 20 and r["buys_m5"] / total >= 0.6
        firm = r["price"] > ref["price"] and r["price"] >= lowest_level * 0.95 and ref["liq"] > 0 and r["liq"] >= ref["liq"] * 0.95
        return {"price": r["price"]} if busy and firm else None

    return against_reference(judge, ("liq", "price", "vol_m5"), **reach)


def stall(stale_after=180):
    """Status of every check from the flags ``ok``, ``paused``, ``unhealthy`` and ``stopped`` of its row."""
    def step(s, r):
        last = r["ts"] if r["ok"] else s
        silent = last is None or r["ts"] - last > stale_after
        status = "paused" if r["paused"] else "unhealthy" if r["unhealthy"] else "stopped" if r["stopped"] else "stalled" if silent else "collecting"
        return last, [{"id": r["id"], "ts": r["ts"], "last_success": last, "status": status}]

    return step


def incidents_of_checks(stale_after=180, retry=300):
    """Deliveries straight from check rows: the status rule feeds the notice rule."""
    checks, notices = stall(stale_after), incident_transitions(retry)

    def step(s, r):
        a, b = s or (None, None)
        a, found = checks(a, r)
        b, out = notices(b, {**r, "status": found[0]["status"]})
        return [a, b], out

    return step


def identity_reset(window, tolerance):
    """Movement in percent against the latest row ``window`` to ``window + tolerance`` seconds before, among rows since the
    fingerprint ``fp`` last changed; ``epoch`` counts the changes."""
    def step(s, r):
        fp, epoch, rows = s or (r["fp"], 0, [])
        if r["fp"] != fp:
            fp, epoch, rows = r["fp"], epoch + 1, []
        rows = [x for x in rows if x[0] >= r["ts"] - window - tolerance]
        base = [x[1] for x in rows if x[0] <= r["ts"] - window]
        pct = round((r["price"] / base[-1] - 1) * 100, 6) if base and base[-1] else None
        return [fp, epoch, [*rows, [r["ts"], r["price"]]]], [{"id": r["id"], "epoch": epoch, "move_pct": pct}]

    return step
