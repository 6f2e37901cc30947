"""Plain loops that say what the ordered operators must return."""


def first_per_window(rows, window, inclusive):
    """rows: (key, ts, id); the ids that are kept."""
    last, kept = {}, []
    for key, ts, name in sorted(rows):
        age = None if key not in last else ts - last[key]
        if age is None or age > window or (age == window and not inclusive):
            last[key] = ts
            kept.append(name)
    return sorted(kept)


def threshold(rows, window, wanted):
    held, fired = {}, []
    for key, ts, name in sorted(rows):
        times = [t for t in held.get(key, []) if t > ts - window] + [ts]
        if len(times) >= wanted:
            fired.append(name)
            times = []
        held[key] = times
    return sorted(fired)


def sequence(rows, window, steps):
    """rows: (key, ts, id, kind); steps: (kinds, count)."""
    states, fired = {}, []
    for key, ts, name, kind in sorted(rows):
        state = states.get(key)
        if state and state["began"] is not None and ts - state["began"] > window:
            state = None
        state = state or {"step": 0, "count": 0, "began": None}
        states[key] = state
        kinds, count = steps[state["step"]]
        if kind not in kinds:
            continue
        if state["began"] is None:
            state["began"] = ts
        state["count"] += 1
        if state["count"] < max(count, 1):
            continue
        state["step"] += 1
        state["count"] = 0
        if state["step"] == len(steps):
            fired.append(name)
            del states[key]
    return sorted(fired)


def token_bucket(rows, interval, capacity):
    """rows: (key, ts, id); refills fall on multiples of the interval from the key's first row."""
    tokens, origin, tick, allowed = {}, {}, {}, []
    for key, ts, name in sorted(rows):
        if key not in tokens:
            tokens[key], origin[key], tick[key] = capacity, ts, 0
        now = (ts - origin[key]) // interval
        tokens[key] = min(capacity, tokens[key] + now - tick[key])
        tick[key] = now
        if tokens[key] > 0:
            tokens[key] -= 1
            allowed.append(name)
    return sorted(allowed)
