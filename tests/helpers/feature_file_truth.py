"""Plain Python versions of the file rules, for comparison on small inputs."""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq


def name(x):
    return "".join(c for c in x.upper() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def missing(v):
    return v is None or isinstance(v, str) and v.strip().upper() in ("", "NA", "N/A", "NULL")


def number(v):
    if isinstance(v, bool):
        return None
    if isinstance(v, (int, float)):
        return float(v)
    if isinstance(v, str) and re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", v.strip(), re.A):
        return float(v.strip())
    return None


def load(folder):
    rows = pq.read_table(f"{folder}/score_requests.parquet").to_pylist()
    files, seen, lines = {}, set(), defaultdict(list)
    for r in sorted(rows, key=lambda r: r["line_id"]):
        files[r["file_id"]] = (r["source_name"], r["file_seq"])
        if (r["file_id"], r["line_no"]) in seen:
            continue
        seen.add((r["file_id"], r["line_no"]))
        try:
            d = json.loads(r["features"] or "")
        except ValueError:
            continue
        if isinstance(d, dict):
            lines[r["file_id"]].append((r["account_reference"], d))
    prev, by_source = {}, defaultdict(list)
    for f, (s, q) in files.items():
        by_source[s].append((q, f))
    for own in by_source.values():
        own.sort()
        for (_, a), (_, b) in zip(own, own[1:]):
            prev[b] = a
    registry = pq.read_table(f"{folder}/feature_registry.parquet").to_pylist()
    dry = pq.read_table(f"{folder}/organiser_dry_run.parquet").to_pylist()
    return files, lines, prev, registry, dry


def type_of(lines, field):
    c = Counter()
    for _, d in lines:
        v = d.get(field)
        if not missing(v):
            c["boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"] += 1
    return max(("number", "string", "boolean"), key=lambda t: c[t]) if c else None


def p3(folder):
    files, lines, prev, registry, dry = load(folder)
    feature = {name(n): r["feature"] for r in registry for n in (r["feature"], r["variable_name"])}
    fields = {f: {k for _, d in lines[f] for k in d} for f in files}
    out = set()
    for f, p in prev.items():
        gone, new = fields[p] - fields[f], fields[f] - fields[p]
        pairs = set()
        for a in gone:
            for b in new:
                fa, fb = feature.get(name(a)), feature.get(name(b))
                ok = name(a) == name(b) or fa is not None and fa == fb
                if not ok and not (fa and fb):
                    left = {acc: d[a] for acc, d in lines[p] if not missing(d.get(a))}
                    right = {acc: d[b] for acc, d in lines[f] if not missing(d.get(b))}
                    both = left.keys() & right.keys()
                    same = 0
                    for acc in both:
                        x, y = left[acc], right[acc]
                        nx, ny = number(x), number(y)
                        same += nx == ny if nx is not None and ny is not None else str(x).strip() == str(y).strip()
                    ok = same >= 10 and same * 10 >= 9 * len(both)
                if ok:
                    pairs.add((a, b))
        out |= {(f, "renamed", a, b) for a, b in pairs}
        out |= {(f, "removed", a, "") for a in gone - {a for a, _ in pairs}}
        out |= {(f, "added", b, "") for b in new - {b for _, b in pairs}}
        for a, b in [(x, x) for x in fields[f] & fields[p]] + list(pairs):
            ta, tb = type_of(lines[p], a), type_of(lines[f], b)
            if ta and tb and ta != tb:
                out.add((f, "type_changed", b, ""))
    for r in dry:
        n = r["n_unexpected_columns"]
        if r["file_id"] in files and n is not None and n != sum(name(k) not in feature for k in fields[r["file_id"]]):
            out.add((r["file_id"], "miscounted", "n_unexpected_columns", ""))
    return out


def quantile(v, q):
    v = sorted(v)
    k = q * (len(v) - 1)
    i = int(k)
    return v[i] + (v[min(i + 1, len(v) - 1)] - v[i]) * (k - i)


def p5(folder):
    files, lines, prev, registry, dry = load(folder)
    feature = {name(n): r["feature"] for r in registry for n in (r["feature"], r["variable_name"])}
    values = {}
    for f in files:
        has = {feature[name(k)] for _, d in lines[f] for k in d if name(k) in feature}
        for x in has:
            values[f, x] = []
        for _, d in lines[f]:
            row = defaultdict(lambda: None)
            for k, v in d.items():
                x = feature.get(name(k))
                if x and not missing(v):
                    row[x] = v
            for x in has:
                values[f, x].append(row[x])
    out = set()
    for r in registry:
        x, kind = r["feature"], r["value_kind"]
        for f in files:
            if (f, x) not in values:
                continue
            v, before = values[f, x], values.get((prev.get(f), x))
            share = lambda w: sum(z is None for z in w) / len(w)
            if before and abs(share(v) - share(before)) > 0.30 + 1e-7:
                out.add((f, x, "null_rate"))
            if kind in ("code", "date") and any(z is not None and not (isinstance(z, str) and re.fullmatch(r["value_pattern"], z)) for z in v):
                out.add((f, x, "pattern"))
            if kind in ("amount", "ratio", "count"):
                if any(z is not None and number(z) is None for z in v):
                    out.add((f, x, "pattern"))
                nums = [number(z) for z in v if z is not None and number(z) is not None]
                if any(z < r["lo_bound"] - 1e-7 or z > r["hi_bound"] + 1e-7 for z in nums):
                    out.add((f, x, "range"))
                if len(nums) >= 10 and min(nums) == max(nums):
                    out.add((f, x, "constant"))
                old = [number(z) for z in before or () if z is not None and number(z) is not None]
                if len(nums) >= 10 and len(old) >= 10:
                    m = quantile(nums, 0.5)
                    if m < quantile(old, 0.1) - 1e-7 or m > quantile(old, 0.9) + 1e-7:
                        out.add((f, x, "shift"))
    required = sum(bool(r["is_required"]) for r in registry)
    for r in dry:
        for column, top in (("n_missing_required", required), ("schema_completeness", 1)):
            z = r[column]
            if z is None:
                out.add((r["file_id"], column, "null_rate"))
            elif not 0 - 1e-7 <= z <= top + 1e-7:
                out.add((r["file_id"], column, "range"))
    return out
