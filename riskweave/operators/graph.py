"""Directed transaction graphs: (account_from, account_to, amount, timestamp) edges.

An account may hold a third of all edges, so nothing here gathers an account's edges:
time windows run over (account, day) pieces whose ends are joined, and iterations
move (label, account) rows, written between rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import release
from .quantiles import running_counts, value_counts
from .ranking import divide

#: Limits of the structures (fixed values).
FAN_MIN, PASS_RATIO, PASS_HOURS, HOP_HOURS, CHAIN_MIN, CYCLE_MAX = 10, 0.90, 48, 24, 3, 6
SMURF_SENDERS, SMURF_RATIO, SHELL_RECIPIENTS, SHELL_SENDERS, BURST_MULTIPLE = 5, 0.25, 10, 2, 3.0
#: Accepted header names of the four columns, first match wins (fixed values).
ALIASES = {
    "account_from": ("account_from", "from_account", "source", "sender", "src", "from"),
    "account_to": ("account_to", "to_account", "target", "receiver", "dst", "to"),
    "amount": ("amount", "value", "amt", "txn_amount"),
    "timestamp": ("timestamp", "ts", "time", "date", "txn_date"),
}

_DAY = 86_400_000_000


def edge_columns(df: DataFrame) -> DataFrame:
    """The four columns under their own names, found by alias whatever the case; a missing one is an error, a missing time null."""
    have = {c.strip().lower(): c for c in reversed(df.columns)}
    picked = []
    for name, aliases in ALIASES.items():
        hit = next((have[a] for a in aliases if a in have), None)
        if hit is None and name != "timestamp":
            raise ValueError(f"no column for {name}")
        picked.append((F.col(f"`{hit}`") if hit else F.lit(None).cast("timestamp")).alias(name))
    return df.select(*picked)


def _typed(raw: DataFrame) -> DataFrame:
    stamp = F.col("timestamp")
    if dict(raw.dtypes)["timestamp"] == "string":
        stamp = F.coalesce(F.try_to_timestamp(stamp), F.try_to_timestamp(stamp, F.lit("MM-dd-yyyy")))
    return raw.select(F.trim(F.col("account_from").cast("string")).alias("account_from"), F.trim(F.col("account_to").cast("string")).alias("account_to"), F.col("amount").try_cast("double").alias("amount"), stamp.cast("timestamp").alias("timestamp"))


def clean_edges(raw: DataFrame) -> DataFrame:
    """Trimmed ids, parsed times (null if unreadable), no self-loops, no null or non-positive amounts, no null ids."""
    return _typed(raw).where("account_from <> account_to AND amount > 0")


def edge_report(raw: DataFrame) -> DataFrame:
    """One row: edges in, self-loops, bad amounts among the rest, kept edges, kept edges without time."""
    e, loop, good = _typed(raw), F.expr("account_from = account_to"), F.expr("account_from <> account_to")
    fine = good & F.coalesce(F.col("amount") > 0, F.lit(False))
    return e.agg(
        F.count(F.lit(1)).alias("n_in"), F.count_if(loop).alias("n_self_loops"), F.count_if(good & ~fine).alias("n_bad_amount"), F.count_if(fine).alias("n_kept"), F.count_if(fine & F.col("timestamp").isNull()).alias("n_no_time")
    )


def availability(edges: DataFrame) -> DataFrame:
    """One row (status, n_edges): AVAILABLE, or NO_EDGES where nothing was given or nothing is left after cleaning."""
    return edges.agg(F.count(F.lit(1)).alias("n_edges")).select(F.when(F.col("n_edges") > 0, "AVAILABLE").otherwise("NO_EDGES").alias("status"), "n_edges")


def account_metrics(edges: DataFrame) -> DataFrame:
    """(account, n_in, n_out, senders, recipients, value_in, value_out, passthrough, fan_ratio) of every account.

    passthrough = min(in, out) / in, 0 without inflow.
    """
    one, zero = F.lit(1), F.lit(0).cast("bigint")
    inn = edges.groupBy(F.col("account_to").alias("account")).agg(F.count(one).alias("n_in"), F.count_distinct("account_from").alias("senders"), F.sum("amount").alias("value_in"))
    out = edges.groupBy(F.col("account_from").alias("account")).agg(F.count(one).alias("n_out"), F.count_distinct("account_to").alias("recipients"), F.sum("amount").alias("value_out"))
    both = inn.join(out, "account", "full").select("account", *(F.coalesce(c, zero).alias(c) for c in ("n_in", "n_out", "senders", "recipients")), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("value_in", "value_out")))
    return both.withColumns({
        "passthrough": F.coalesce(divide(F.least("value_in", "value_out"), F.col("value_in")), F.lit(0.0)), "fan_ratio": divide(F.col("senders").cast("double"), F.col("recipients")),
    })


def _stamps(edges: DataFrame, account: str) -> DataFrame:
    t = F.unix_micros("timestamp")
    return edges.where("timestamp IS NOT NULL").select(F.col(account).alias("account"), t.alias("t"), F.floor(t / _DAY).alias("day"))


def dwell_times(edges: DataFrame) -> DataFrame:
    """(account, t, hours): for each inbound edge the hours to the account's next outbound edge at or after it.

    Outbound edges may serve many inbound ones; inbound edges without a later outbound have no row. An
    as-of join: within each (account, day) by a window, else the first outbound of a later day. Windows
    run from the latest row back, so that each row is added once.
    """
    inn = _stamps(edges, "account_to").withColumn("out", F.lit(None).cast("bigint"))
    out = _stamps(edges, "account_from").withColumn("out", F.col("t"))
    ahead = Window.partitionBy("account", "day").orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, 0)
    same = inn.withColumn("is_in", F.lit(True)).unionByName(out.withColumn("is_in", F.lit(False))).withColumn("next", F.min("out").over(ahead)).where("is_in")
    days = inn.select("account", "day").union(out.select("account", "day")).distinct().join(out.groupBy("account", "day").agg(F.min("out").alias("first")), ["account", "day"], "left")
    later = Window.partitionBy("account").orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    following = days.select("account", "day", F.min("first").over(later).alias("later"))
    hours = (F.coalesce("next", "later") - F.col("t")) / 3.6e9
    return same.join(following, ["account", "day"]).select("account", "t", hours.alias("hours")).where("hours IS NOT NULL")


def upper_medians(rows: DataFrame, value: str, name: str) -> DataFrame:
    """(account, n, name): the value at place n // 2 (from 0) of each account's sorted values, from counts in pieces."""
    run = running_counts(value_counts(rows, ["account"], value), ["account"])
    place = F.floor(F.col("total") / 2)
    return run.where((F.col("cum_n") > place) & (F.col("cum_n") - F.col("n") <= place)).select("account", F.col("total").alias("n"), F.col("value").alias(name))


def dwell_medians(edges: DataFrame) -> DataFrame:
    """(account, n_matched, median_dwell_hours) with the upper median."""
    return upper_medians(dwell_times(edges), "hours", "median_dwell_hours").withColumnRenamed("n", "n_matched")


def smurfing(edges: DataFrame) -> DataFrame:
    """(account, senders, median_inbound, largest_outbound, ratio, detected) of accounts with edges both ways."""
    inn = edges.groupBy(F.col("account_to").alias("account")).agg(F.count_distinct("account_from").alias("senders"))
    median = upper_medians(edges.select(F.col("account_to").alias("account"), "amount"), "amount", "median_inbound").drop("n")
    out = edges.groupBy(F.col("account_from").alias("account")).agg(F.max("amount").alias("largest_outbound"))
    ratio = F.col("median_inbound") / F.col("largest_outbound")
    return inn.join(median, "account").join(out, "account").withColumn("ratio", ratio).withColumn("detected", (F.col("senders") >= SMURF_SENDERS) & (F.col("ratio") <= SMURF_RATIO))


def distributors(metrics: DataFrame) -> DataFrame:
    """(account, senders, recipients, retained_share, detected): many recipients, one or two senders."""
    kept = divide(F.col("value_in") - F.least("value_in", "value_out"), F.col("value_in"))
    return metrics.select("account", "senders", "recipients", kept.alias("retained_share"), ((F.col("recipients") >= SHELL_RECIPIENTS) & F.col("senders").between(1, SHELL_SENDERS)).alias("detected"))


def velocity(edges: DataFrame, hours: int = 24) -> DataFrame:
    """(account, n_stamps, span_hours, busiest, multiple, status): the busiest trailing window against the account's own rate.

    A window is inclusive at exactly `hours`. status: NO_BASELINE below four stamps, ONE_STAMP at
    span 0, SHORT_SPAN below one window (multiple null then), else BURST or NORMAL. Each stamp is also
    sent to the next piece of time, so that no window needs a whole account.
    """
    both = _stamps(edges, "account_to").union(_stamps(edges, "account_from"))
    width = hours * 3_600_000_000
    piece = F.floor(F.col("t") / width)
    spread = both.select("account", "t", piece.alias("own"), F.explode(F.array(piece, piece + 1)).alias("piece"))
    back = Window.partitionBy("account", "piece").orderBy("t").rangeBetween(-width, 0)
    busiest = spread.select("account", "own", "piece", F.count(F.lit(1)).over(back).alias("n")).where("own = piece").groupBy("account").agg(F.max("n").alias("busiest"))
    sums = both.groupBy("account").agg(F.count(F.lit(1)).alias("n_stamps"), ((F.max("t") - F.min("t")) / 3.6e9).alias("span_hours"))
    n, span = F.col("n_stamps"), F.col("span_hours")
    status = F.when(n < 4, "NO_BASELINE").when(span <= 0, "ONE_STAMP").when(span < hours, "SHORT_SPAN")
    multiple = F.when(status.isNull(), F.col("busiest") / (n / (span / hours)))
    return sums.join(busiest, "account").select("account", "n_stamps", "span_hours", "busiest", multiple.alias("multiple"), F.coalesce(status, F.when(multiple >= BURST_MULTIPLE, "BURST").otherwise("NORMAL")).alias("status"))


def links(edges: DataFrame) -> DataFrame:
    """(a, b): the distinct directed links."""
    return edges.select(F.col("account_from").alias("a"), F.col("account_to").alias("b")).distinct()


def weak_components(edges: DataFrame, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(account, component): the smallest account of each weakly connected component.

    Labels move along links and then jump to their label's label, so rounds grow with the logarithm
    of a component's width; settle(df) writes each round, and the round before last is removed.
    """
    pairs = links(edges)
    both = settle(pairs.union(pairs.select("b", "a")).toDF("a", "b").distinct())
    label = settle(both.groupBy(F.col("a").alias("account")).agg(F.least("account", F.min("b")).alias("component")))
    while True:
        now = label.select("account", "component")
        heard = both.join(now.withColumnRenamed("account", "b"), "b").groupBy(F.col("a").alias("account")).agg(F.min("component").alias("near"))
        better = now.join(heard, "account").select("account", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        jump = better.select(F.col("account").alias("component"), F.col("component").alias("root"))
        nxt = settle(better.join(jump, "component", "left").select("account", F.least("component", F.coalesce("root", "component")).alias("component"), "was"))
        release(label)
        label = nxt
        if label.where("component <> was").isEmpty():
            return label.select("account", "component")


def _reached(pairs: DataFrame, start: DataFrame, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(account): the accounts that links lead to from the start, itself included; each link is followed once."""
    seen = front = settle(start)
    while True:
        ahead = pairs.join(front.select(F.col("account").alias("a")), "a").select(F.col("b").alias("account")).distinct()
        front = settle(ahead.join(seen, "account", "left_anti"))
        if front.isEmpty():
            return seen
        wider = settle(seen.unionByName(front))
        release(seen)
        seen = wider


def _inside(pairs: DataFrame, rest: DataFrame) -> DataFrame:
    return pairs.join(rest.withColumnRenamed("account", "a"), "a", "left_semi").join(rest.withColumnRenamed("account", "b"), "b", "left_semi").select("a", "b")


def strong_components(edges: DataFrame, settle: Callable[[DataFrame], DataFrame], trims: int = 2) -> DataFrame:
    """(account, scc): strongly connected components, named by their largest account.

    Accounts without a way in or out are components of their own and are trimmed first. The large
    component is what is reached both forward and backward from the account with the most links. The
    rest goes by forward colouring: the largest label that reaches an account moves on until it settles,
    and the accounts of a colour that reach its root backwards are that root's component; then again
    with what is left.
    """
    pairs = settle(links(edges))
    ins, outs = pairs.groupBy(F.col("b").alias("account")).agg(F.count(F.lit(1)).alias("i")), pairs.groupBy(F.col("a").alias("account")).agg(F.count(F.lit(1)).alias("o"))
    pivot = ins.join(outs, "account").orderBy((F.col("i") * F.col("o")).desc(), "account").limit(1).select("account")
    found = []
    forward = _reached(pairs, pivot, settle)
    backward = _reached(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), pivot, settle)
    large = settle(forward.join(backward, "account", "left_semi"))
    found.append(large.crossJoin(large.agg(F.max("account").alias("scc"))))  # one row
    everyone = edges.select(F.col("account_from").alias("account")).union(edges.select("account_to")).distinct()
    rest = settle(everyone.join(large, "account", "left_anti"))
    while not rest.isEmpty():
        inside = settle(_inside(pairs, rest))
        for _ in range(trims):
            core = settle(inside.select(F.col("a").alias("account")).intersect(inside.select("b")))
            found.append(rest.join(core, "account", "left_anti").select("account", F.col("account").alias("scc")))
            rest, inside = core, settle(_inside(inside, core))
        if rest.isEmpty():
            break
        colour = rest.select("account", F.col("account").alias("colour"))
        while True:
            sent = inside.join(colour.select(F.col("account").alias("a"), "colour"), "a").groupBy(F.col("b").alias("account")).agg(F.max("colour").alias("near"))
            nxt = settle(colour.drop("was").join(sent, "account", "left").select("account", F.greatest("colour", F.coalesce("near", "colour")).alias("colour"), F.col("colour").alias("was")))
            release(colour)
            colour = nxt
            if colour.where("colour <> was").isEmpty():
                break
        label = colour.select("account", "colour")
        roots = label.where("account = colour")
        back = inside.join(label.toDF("a", "ca"), "a").join(label.toDF("b", "cb"), "b").where("ca = cb").select(F.col("b").alias("a"), F.col("a").alias("b"))
        own = settle(_reached(settle(back), roots.select("account"), settle).join(label, "account"))
        found.append(own.select("account", F.col("colour").alias("scc")))
        rest = settle(rest.join(own, "account", "left_anti"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def component_sizes(labels: DataFrame, label: str) -> DataFrame:
    """(account, label, size)."""
    return labels.join(labels.groupBy(label).agg(F.count(F.lit(1)).alias("size")), label).select("account", label, "size")


def _cycles(pairs: DataFrame, seeds: DataFrame | None, most: int, settle) -> DataFrame:
    """(account, length) of the shortest cycle of links through each seed (null: every account) that has one of up to `most`.

    On a shortest cycle of n links the account n - n // 2 hops ahead is n // 2 hops behind, so both ways go half
    as far; an account whose cycle is found goes no further.
    """
    steps = (pairs, pairs.toDF("b", "a").select("a", "b"))
    own = steps if seeds is None else [p.join(seeds.toDF("a"), "a", "left_semi") for p in steps]
    reach = [settle(p.select(F.col("a").alias("seed"), F.col("b").alias("account"), F.lit(1).alias("hop"))) for p in own]
    hops, found = [1, 1], None
    for length in range(2, most + 1):
        if length > 2:
            way = 1 - length % 2  # odd lengths take a hop more ahead, even ones behind
            last = reach[way].where(F.col("hop") == hops[way])
            new = last.join(steps[way].withColumnRenamed("a", "account"), "account").select("seed", F.col("b").alias("account")).where("account <> seed").distinct()
            hops[way] += 1
            further = settle(reach[way].unionByName(new.join(reach[way], ["seed", "account"], "left_anti").withColumn("hop", F.lit(hops[way]))))
            release(reach[way])
            reach[way] = further
        meet = reach[0].where(F.col("hop") == hops[0]).join(reach[1].where(F.col("hop") == hops[1]), ["seed", "account"], "left_semi")
        now = settle(meet.select(F.col("seed").alias("account")).distinct().withColumn("length", F.lit(length)))
        found = now if found is None else found.unionByName(now)
        if length < most:
            rest = [settle(x.join(now.select(F.col("account").alias("seed")), "seed", "left_anti")) for x in reach]
            release(*reach)
            reach = rest
    release(*reach)
    return found


def shortest_cycles(edges: DataFrame, seeds: DataFrame, settle, most: int = CYCLE_MAX) -> DataFrame:
    """(account, length) of the shortest directed cycle through each seed, up to `most` edges."""
    return _cycles(settle(links(edges)), seeds, most, settle)


def cycle_lengths(edges: DataFrame, settle, most: int = CYCLE_MAX) -> DataFrame:
    """(account, length) of the shortest directed cycle through every account that has one of up to `most` edges.

    A cycle stays in one strong component, so other links are dropped first.
    """
    label = settle(strong_components(edges, settle))
    inside = links(edges).join(label.toDF("a", "sa"), "a").join(label.toDF("b", "sb"), "b").where("sa = sb").select("a", "b")
    return _cycles(settle(inside), None, most, settle)


def ego_network(edges: DataFrame, seeds: DataFrame, settle, hops: int = 2, most_nodes: int = 60) -> DataFrame:
    """(seed, account, hop) within `hops` edges in any direction, the nearest `most_nodes` (then by account), the seed at hop 0.

    A seed whose net is full goes no further, and each hop keeps only what still has room, so a net
    never grows beyond most_nodes rows before its hubs are expanded.
    """
    pairs = links(edges)
    both = settle(pairs.union(pairs.select("b", "a")).toDF("a", "b").distinct())
    seen = front = settle(seeds.toDF("seed").select("seed", F.col("seed").alias("account"), F.lit(0).alias("hop")))
    near = Window.partitionBy("seed").orderBy("account")
    for hop in range(1, hops + 1):
        room = seen.groupBy("seed").agg((F.lit(most_nodes) - F.count(F.lit(1))).alias("room")).where("room > 0")
        asks = front.join(room.select("seed"), "seed", "left_semi").select("seed", F.col("account").alias("a"))
        new = both.join(asks, "a").select("seed", F.col("b").alias("account")).distinct().join(seen, ["seed", "account"], "left_anti")
        placed = new.withColumn("n", F.row_number().over(near)).where(F.col("n") < most_nodes).join(room, "seed").where("n <= room")
        front = settle(placed.select("seed", "account", F.lit(hop).alias("hop")))
        seen = settle(seen.unionByName(front))
    return seen


def rapid_chains(edges: DataFrame, settle, most: int = 8, hours: int = HOP_HOURS) -> DataFrame:
    """(account, depth): the most hops, up to `most`, of a chain that starts at the account, each hop 0..hours after the one before.

    Exact for chains that may pass an account again (the pruned search it stands for is order
    dependent). Each round an edge learns the depth of the edges that may follow it. The stretch of
    time an edge looks at is the end of one piece of time and the beginning of the next, so the two
    maxima are running ones in windows over (account, piece): edges never meet as pairs.
    """
    width = hours * 3_600_000_000
    t = F.unix_micros("timestamp")
    base = settle(edges.where("timestamp IS NOT NULL").select("account_from", "account_to", t.alias("t")).distinct())
    asked = base.select(F.col("account_to").alias("account"), "t").distinct()
    piece = lambda c: F.floor(c / width)
    none = F.lit(None)
    asks = settle(
        asked.select("account", piece(F.col("t")).alias("piece"), F.col("t").alias("at"), none.cast("int").alias("d"), F.col("t").alias("own"), F.lit(1).alias("side"))
        .unionByName(asked.select("account", (piece(F.col("t")) + 1).alias("piece"), (F.col("t") + width).alias("at"), none.cast("int").alias("d"), F.col("t").alias("own"), F.lit(2).alias("side")))
    )
    up = Window.partitionBy("account", "piece").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("account", "piece").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, 0)
    deep = base.withColumn("depth", F.lit(1))
    for _ in range(most - 1):
        level = deep.groupBy(F.col("account_from").alias("account"), "t").agg(F.max("depth").alias("d"))
        rows = asks.unionByName(level.select("account", piece(F.col("t")).alias("piece"), F.col("t").alias("at"), "d", none.cast("bigint").alias("own"), F.lit(0).alias("side")))
        seen = rows.withColumn("best", F.when(F.col("side") == 1, F.max("d").over(down)).when(F.col("side") == 2, F.max("d").over(up))).where("side > 0 AND best IS NOT NULL")
        best = seen.groupBy(F.col("account").alias("account_to"), F.col("own").alias("t")).agg((F.max("best") + 1).alias("d"))
        nxt = settle(base.join(best, ["account_to", "t"], "left").select("account_from", "account_to", "t", F.least(F.coalesce("d", F.lit(1)), F.lit(most)).alias("depth")))
        release(deep)
        deep = nxt
    return deep.groupBy(F.col("account_from").alias("account")).agg(F.max("depth").alias("depth"))


def structures(metrics: DataFrame, dwell: DataFrame, chains: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """(account, patterns): names of the structures an account takes part in, joined by commas."""
    rows = metrics.join(dwell, "account", "left").join(chains, "account", "left")
    names = [
        F.when(F.col("senders") >= FAN_MIN, "FAN_IN_COLLECTION"), F.when(F.col("recipients") >= FAN_MIN, "FAN_OUT_DISPERSAL"),
        F.when((F.col("passthrough") >= PASS_RATIO) & (F.col("median_dwell_hours") <= PASS_HOURS), "RAPID_PASSTHROUGH"), F.when(F.col("depth") >= CHAIN_MIN, "LAYERING_CHAIN"),
    ]
    if cycles is not None:
        rows = rows.join(cycles, "account", "left")
        names.append(F.when(F.col("length").isNotNull(), "CIRCULAR_FLOW"))
    return rows.select("account", F.array_join(F.array_compact(F.array(*names)), ",").alias("patterns"))


def top_accounts(metrics: DataFrame, k: int = 20) -> DataFrame:
    """(board, place, account): the k accounts with the highest pass-through (then inflow) and the highest fan-in plus fan-out."""
    boards = []
    for board, order in (("passthrough", [F.round("passthrough", 4).desc(), F.round("value_in", 2).desc(), "account"]), ("fan", [(F.col("senders") + F.col("recipients")).desc(), "account"])):
        top = metrics.orderBy(*order).limit(k)
        boards.append(top.select(F.lit(board).alias("board"), F.row_number().over(Window.orderBy(*order)).alias("place"), "account"))  # k rows
    return boards[0].union(boards[1])
