"""DuckDB SQL for the registered queries: the independent correctness oracle.

Each string computes, in plain SQL over the given tables, what the matching
Spark query computes: same seeded draws (md5 of ``seed|table|column|key``), same
arithmetic order (so doubles agree bit for bit) and the same output names/types.
"""

from __future__ import annotations

import math
from datetime import datetime
from functools import lru_cache
from itertools import combinations_with_replacement
from typing import NamedTuple

from rowsmith.functions import pools
from rowsmith.plans import registry as R

# Written out here, not imported, so that a wrong rule set, distribution table or keyword list in the library
# shows: seeds, times, rule lists, keyword lists, defaults, and the two distribution tables computed anew.
SEED = 42
TWO52 = float(2 ** 52)
AS_OF = datetime(2024, 2, 1)
PLAIN = "positive"


class Rule(NamedTuple):
    source: str
    target: str
    kind: str
    strength: float
    direction: str = PLAIN

    @property
    def sign(self) -> float:
        return 1.0 if self.direction == PLAIN else -1.0


CHAIN_RULES = (
    Rule("l_quantity", "l_extendedprice", "num_num", 0.35), Rule("l_returnflag", "l_extendedprice", "bool_num", 0.22),
    Rule("l_linestatus", "l_extendedprice", "bool_num", 0.22), Rule("is_large", "l_extendedprice", "bool_num", 0.22),
    Rule("l_discount", "l_tax", "num_num", 0.5), Rule("l_extendedprice", "is_large", "num_bool", 0.42))
WHOLE_TABLE_RULES = (
    Rule("l_quantity", "l_tax", "num_num", 0.5), Rule("l_quantity", "l_extendedprice", "num_num", 0.35),
    Rule("l_discount", "l_tax", "num_num", 0.5), Rule("l_discount", "l_extendedprice", "num_num", 0.35),
    Rule("l_linenumber", "l_tax", "num_num", 0.5), Rule("l_linenumber", "l_extendedprice", "num_num", 0.35),
    Rule("l_suppkey", "l_tax", "num_num", 0.5), Rule("l_suppkey", "l_extendedprice", "num_num", 0.35),
    Rule("l_partkey", "l_tax", "num_num", 0.5), Rule("l_partkey", "l_extendedprice", "num_num", 0.35))
VISIT_RULES = (Rule("readmission_risk_score", "cost", "num_num", 0.35),)
POISSON_WORDS = ("count", "qty", "quantity")
BETA_WORDS = ("score", "probability", "rate", "ratio")
AMOUNT_WORDS = ("amount", "price", "cost", "value")
RARE_FLAG_WORDS = ("fraud", "risk", "abnormal")
ORDERED_DATE_WORDS = ("created", "start", "signup", "opened")
ORDERED_TS_WORDS = ("created", "event", "timestamp", "occurred", "updated")
INT_DEFAULT, FLOAT_DEFAULT = (0, 10000), (0.0, 1000.0)
BETA_A, BETA_B, BETA_POINTS = 2.2, 3.6, 1024
LOGNORMAL_SIGMA = 0.85
RARE_FLAG_P, FLAG_P = 0.18, 0.5
DAYS_BACK, HOURS_BACK = 730, 8760


@lru_cache(maxsize=64)
def poisson_cdf(lam: float) -> tuple:
    """P(X <= k) until nothing is left that a double shows, each probability from the log-gamma function."""
    one = lambda i: math.exp(i * math.log(lam) - lam - math.lgamma(i + 1))
    last = next(k for k in range(int(lam), 10_000) if one(k) < 1e-18)
    return tuple(min(1.0, math.fsum(map(one, range(k + 1)))) for k in range(last))


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(1.0 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        term = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0
                                   else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1.0 / (1.0 + term * d or 1e-300)
        c = 1.0 + term / c or 1e-300
        value *= c * d
        if abs(1.0 - c * d) < 1e-16:
            break
    return front * (value - 1.0)


@lru_cache(maxsize=4)
def beta_quantiles(a: float, b: float) -> tuple:
    out = [0.0]
    for i in range(1, BETA_POINTS):
        lo, hi = out[-1], 1.0
        for _ in range(50):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if beta_cdf(mid, a, b) < i / BETA_POINTS else (lo, mid)
        out.append((lo + hi) / 2)
    return (*out, 1.0)


def status_values(name: str) -> tuple:
    """The vocabulary of the first keyword that the column's name holds."""
    return next((v for k, v in pools.STATUS_VALUES if k in name.lower()), pools.DEFAULT_STATUS)

# Column lists of the given tables (name, kind): kind 'f' marks floating columns.
SCHEMAS = {
    "region": [("r_regionkey", "i"), ("r_name", "s")],
    "nation": [("n_nationkey", "i"), ("n_name", "s"), ("n_regionkey", "i")],
    "customer": [("c_custkey", "i"), ("c_name", "s"), ("c_nationkey", "i"), ("c_acctbal", "f"),
                 ("c_mktsegment", "s")],
    "supplier": [("s_suppkey", "i"), ("s_name", "s"), ("s_nationkey", "i"), ("s_acctbal", "f")],
    "part": [("p_partkey", "i"), ("p_name", "s"), ("p_brand", "s"), ("p_type", "s"), ("p_size", "i"),
             ("p_retailprice", "f")],
    "orders": [("o_orderkey", "i"), ("o_custkey", "i"), ("o_orderstatus", "s"), ("o_totalprice", "f"),
               ("o_orderdate", "t"), ("o_orderpriority", "s")],
    "lineitem": [("l_orderkey", "i"), ("l_partkey", "i"), ("l_suppkey", "i"), ("l_linenumber", "i"),
                 ("l_quantity", "f"), ("l_extendedprice", "f"), ("l_discount", "f"), ("l_tax", "f"),
                 ("l_returnflag", "s"), ("l_linestatus", "s"), ("l_shipdate", "t")],
    "events": [("event_id", "i"), ("ts", "t"), ("user_id", "i"), ("event_type", "s"), ("value", "f"),
               ("props", "s")],
    "documents": [("doc_id", "i"), ("text", "s"), ("lang", "s"), ("source", "s"), ("n_chars", "i")],
    "embeddings": [("vec_id", "i"), ("embedding", "a"), ("label", "i")],
    "pages": [("page_id", "i"), ("url", "s"), ("html", "s")],
    "benchmark": [("item_id", "i"), ("text", "s")],
    "labels": [("doc_id", "i"), ("quality", "i"), ("toxic", "i")],
    "conversations": [("conv_id", "i"), ("turn", "i"), ("role", "s"), ("text", "s")],
}


def epoch_of(ts: datetime) -> int:
    return int((ts - datetime(1970, 1, 1)).total_seconds())


def dbl(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def q(s: str) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else dbl(v) for v in values) + "]"


def md5(table: str, column: str, key: str) -> str:
    return f"md5(concat_ws('|', {q(SEED)}, {q(table)}, {q(column)}, CAST({key} AS VARCHAR)))"


def bits(table: str, column: str, key: str, draw: int = 0) -> str:
    return f"CAST(('0x' || substr({md5(table, column, key)}, {1 + 13 * draw}, 13)) AS BIGINT)"


def u(table: str, column: str, key: str, draw: int = 0) -> str:
    return f"(CAST({bits(table, column, key, draw)} AS DOUBLE) / {dbl(TWO52)})"


def u_open(table, column, key, draw=0) -> str:
    return f"(CAST(({bits(table, column, key, draw)} + 1) AS DOUBLE) / {dbl(TWO52)})"


def pick(uexpr: str, values) -> str:
    return f"({lst(values)})[CAST(floor({uexpr} * {len(values)}) AS BIGINT) + 1]"


def as_double(x: str) -> str:
    return f"(CASE WHEN isnan(TRY_CAST({x} AS DOUBLE)) THEN NULL ELSE TRY_CAST({x} AS DOUBLE) END)"


def repair_int(x: str, lo=None, hi=None) -> str:
    v = f"coalesce({as_double(x)}, {dbl(0.0)})"
    if lo is not None:
        v = f"greatest({v}, {dbl(float(int(lo)))})"
    if hi is not None:
        v = f"least({v}, {dbl(float(int(hi)))})"
    return (f"(CASE WHEN {v} >= {dbl(2.0 ** 63)} THEN CAST({2 ** 63 - 1} AS BIGINT) "
            f"WHEN {v} <= {dbl(-(2.0 ** 63))} THEN CAST({-(2 ** 63)} AS BIGINT) "
            f"ELSE CAST(trunc({v}) AS BIGINT) END)")


def repair_float(x: str, lo=None, hi=None, digits: int = 4) -> str:
    v = f"coalesce({as_double(x)}, {dbl(0.0)})"
    if lo is not None:
        v = f"greatest({v}, {dbl(lo)})"
    if hi is not None:
        v = f"least({v}, {dbl(hi)})"
    # Spark rounds through a decimal and never returns -0.0; adding +0.0 maps -0.0 to 0.0
    return f"(round({v}, {digits}) + {dbl(0.0)})"


def constrain(f, x: str, u_allowed: str | None) -> str:
    out = x
    if f.allowed_values:
        vals = list(f.allowed_values)
        out = f"(CASE WHEN {out} IN ({', '.join(q(v) for v in vals)}) THEN {out} ELSE {pick(u_allowed, vals)} END)"
    if f.type == "integer":
        out = repair_int(out, f.min_value, f.max_value)
    elif f.type == "float":
        out = repair_float(out, f.min_value, f.max_value)
    return out


# ---------------------------------------------------------------------------
# Generators (mirror rowsmith.functions.fields with mode='portable').

def gen_field(f, table: str, key: str, rows: int = 0, batched: bool = False, batch_rows: int = 25_000,
              as_of=AS_OF) -> str:
    name = f.name.lower()
    U = lambda col=f.name, draw=0: u(table, col, key, draw)
    if f.allowed_values:
        return pick(U(), f.allowed_values)
    if f.faker == "first_name":
        return first(table, f.name, key)
    if "email" in name:
        return email(table, f.name, key)
    if "name" in name:
        return f"concat_ws(' ', {first(table, f.name, key)}, {last(table, f.name, key)})"
    if "zip" in name or "postal" in name:
        return digits(U(), 5)
    if "phone" in name:
        area = f"CAST(CAST((200 + floor({U(f.name, 0)} * 800)) AS BIGINT) AS VARCHAR)"
        return f"('(' || {area} || ') ' || {digits(U(f.name, 1), 3)} || '-' || {digits(U(f.name + '#2', 0), 4)})"
    if "id" in name and f.type == "string":
        h = md5(table, f.name + "#uuid", key)
        variant = f"substr('89ab', CAST(('0x' || substr({h}, 17, 1)) AS INTEGER) % 4 + 1, 1)"
        return (f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), '4' || substr({h}, 14, 3), "
                f"{variant} || substr({h}, 18, 3), substr({h}, 21, 12))")
    if f.type == "integer":
        lo = int(f.min_value if f.min_value is not None else INT_DEFAULT[0])
        hi = int(f.max_value if f.max_value is not None else INT_DEFAULT[1])
        if any(k in name for k in POISSON_WORDS):
            lam = max(2.0, min(20.0, (hi - lo) / 6 if hi > lo else 3.0))
            s = poisson_sql(U(), poisson_cdf(lam))
            return f"CAST(least(greatest(({s}) + {lo}, {lo}), {max(lo + 1, hi)}) AS BIGINT)"
        width = max(lo + 1, hi + 1) - lo
        return f"CAST(({lo} + floor({U()} * {width})) AS BIGINT)"
    if f.type == "float":
        lo = float(f.min_value if f.min_value is not None else FLOAT_DEFAULT[0])
        hi = float(f.max_value if f.max_value is not None else FLOAT_DEFAULT[1])
        if any(k in name for k in BETA_WORDS):
            qs = beta_quantiles(BETA_A, BETA_B)
            n = len(qs) - 1
            pos = f"({U()} * {dbl(n)})"
            i = f"least(CAST(floor({pos}) AS INTEGER), {n - 1})"
            arr = lst(qs)
            v = f"({arr}[{i} + 1] + (({pos} - {i}) * ({arr}[{i} + 2] - {arr}[{i} + 1])))"
            if hi > lo:
                v = f"({dbl(lo)} + ({v} * {dbl(hi - lo)}))"
            return f"round({v}, 4)"
        if any(k in name for k in AMOUNT_WORDS):
            scale = max((hi - lo) / 4 if hi > lo else 1.0, 1.0)
            z = (f"(sqrt({dbl(-2.0)} * ln({u_open(table, f.name, key, 0)})) * "
                 f"cos({dbl(2.0 * math.pi)} * {u(table, f.name, key, 1)}))")
            v = f"greatest((({dbl(scale)} * exp({dbl(LOGNORMAL_SIGMA)} * {z})) + {dbl(lo)}), {dbl(lo)})"
            if hi > lo:
                v = f"least({v}, {dbl(hi)})"
            return f"round({v}, 2)"
        if hi <= lo:
            return dbl(lo)
        return f"round(({dbl(lo)} + ({U()} * {dbl(hi - lo)})), 4)"
    if f.type == "boolean":
        p = RARE_FLAG_P if any(k in name for k in RARE_FLAG_WORDS) else FLAG_P
        return f"({U()} < {dbl(p)})"
    if f.type in ("date", "datetime"):
        ordered = ORDERED_DATE_WORDS if f.type == "date" else ORDERED_TS_WORDS
        span = DAYS_BACK if f.type == "date" else HOURS_BACK
        if any(k in name for k in ordered):
            row0 = f"({key} - 1)"
            rows_s = rows if isinstance(rows, str) else str(max(int(rows), 1))
            if batched:
                i = f"({row0} % {batch_rows})"
                nb = f"least({batch_rows}, {rows_s} - ({row0} - {i}))"
            else:
                i, nb = row0, rows_s
            pos = f"(({i} + {U()}) / {nb})"
            back = f"({span - 1} - floor({pos} * {span}))"
        else:
            back = f"floor({U()} * {span})"
        if f.type == "date":
            return f"(DATE '{as_of.date().isoformat()}' - CAST({back} AS INTEGER))"
        epoch = epoch_of(as_of)
        return f"(TIMESTAMP '1970-01-01 00:00:00' + to_seconds({epoch} - CAST({back} AS BIGINT) * 3600))"
    if "status" in name:
        return pick(U(), status_values(name))
    if "country" in name:
        return pick(U(), pools.COUNTRIES)
    if "city" in name:
        return pick(U(), pools.CITIES)
    return pick(U(), pools.WORDS)


def poisson_sql(uexpr: str, cdf) -> str:
    def search(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi + 1) // 2
        return f"(CASE WHEN {uexpr} >= {dbl(cdf[mid - 1])} THEN {search(mid, hi)} ELSE {search(lo, mid - 1)} END)"
    return search(0, len(cdf))


def first(table, column, key, draw=0):
    return pick(u(table, column, key, draw), pools.FIRST_NAMES)


def last(table, column, key, draw=1):
    return pick(u(table, column, key, draw), pools.LAST_NAMES)


def digits(uexpr: str, width: int) -> str:
    return f"lpad(CAST(CAST(floor({uexpr} * {10 ** width}) AS BIGINT) AS VARCHAR), {width}, '0')"


def email(table, column, key) -> str:
    t2 = column + "#2"
    num = f"CAST(CAST(floor({u(table, t2, key, 0)} * 1000) AS BIGINT) AS VARCHAR)"
    return (f"(lower({first(table, column, key)}) || '.' || lower({last(table, column, key)}) || {num} || '@' || "
            f"{pick(u(table, t2, key, 1), pools.EMAIL_DOMAINS)})")


# ---------------------------------------------------------------------------
# Rules (as rowsmith.operators.correlate.apply_rule / apply_parent_influence compute them).

def _over(by) -> str:
    return f"OVER (PARTITION BY {', '.join(by)})" if by else "OVER ()"


def safe_z(x, m, sd) -> str:
    return f"(CASE WHEN {sd} IS NOT NULL AND {sd} > 0 THEN ({x} - {m}) / {sd} ELSE {dbl(0.0)} END)"


def std1(sd) -> str:
    return f"(CASE WHEN {sd} IS NOT NULL AND {sd} > 0 THEN {sd} ELSE {dbl(1.0)} END)"


def truthy(col: str, kind: str) -> str:
    if kind == "b":
        v = f"CAST({col} AS INTEGER)"
    elif kind == "s":
        v = f"CAST(length({col}) > 0 AS INTEGER)"
    else:
        v = f"(CASE WHEN isnan(CAST({col} AS DOUBLE)) THEN 1 ELSE CAST({col} <> 0 AS INTEGER) END)"
    return f"CAST(coalesce({v}, 0) AS DOUBLE)"


def rule_ctes(src_cte: str, columns: list[str], kinds: dict, rule, tfield, k: int, by, table: str, key: str,
              tag: str, fill_median: bool = True) -> tuple[list[str], str]:
    """CTEs applying one rule; returns (cte texts, name of the last CTE)."""
    keep = ", ".join(c for c in columns if c != rule.target)
    t = rule.target
    ov = _over(by)
    ua = u(table, f"{t}#rule{k}#allowed", key)
    a, b = f"{tag}a", f"{tag}b"
    if rule.kind == "num_bool":
        s = f"coalesce({as_double(rule.source)}, {dbl(0.0)})"
        ctes = [f"{a} AS (SELECT *, {s} AS __s FROM {src_cte})",
                f"{b} AS (SELECT *, avg(__s) {ov} AS __sm, stddev_samp(__s) {ov} AS __sd FROM {a})"]
        z = safe_z("__s", "__sm", "__sd")
        logit = f"greatest({dbl(-4.0)}, least({dbl(4.0)}, {z} * {dbl(2.2 * rule.strength)}))"
        p = f"({dbl(1.0)} / ({dbl(1.0)} + exp(-{logit})))"
        ctes.append(f"{tag} AS (SELECT {keep}, ({u(table, f'{t}#rule{k}', key)} < {p}) AS {t} FROM {b})")
        return ctes, tag
    if rule.kind == "num_num":
        s = f"coalesce({as_double(rule.source)}, {dbl(0.0)})"
        med = f", median(__t0) {ov} AS __tmed" if fill_median else ""
        tfill = "coalesce(__t0, __tmed)" if fill_median else "__t0"
        c = f"{tag}c"
        ctes = [f"{a} AS (SELECT *, {s} AS __s, {as_double(t)} AS __t0 FROM {src_cte})",
                f"{b} AS (SELECT *, avg(__s) {ov} AS __sm, stddev_samp(__s) {ov} AS __sd{med} FROM {a})",
                f"{c} AS (SELECT *, {tfill} AS __t FROM {b})"]
        last_ = f"{tag}d"
        ctes.append(f"{last_} AS (SELECT *, stddev_samp(__t) {ov} AS __ts FROM {c})")
        src = safe_z("__s", "__sm", "__sd")
    else:
        s = truthy(rule.source, kinds.get(rule.source, "s"))
        ctes = [f"{a} AS (SELECT *, {s} AS __s, coalesce({as_double(t)}, {dbl(0.0)}) AS __t FROM {src_cte})",
                f"{b} AS (SELECT *, stddev_samp(__t) {ov} AS __ts FROM {a})"]
        last_ = b
        src = "__s"
    adj = f"(__t + (({dbl(rule.sign * rule.strength)} * {src}) * {std1('__ts')}))"
    ctes.append(f"{tag} AS (SELECT {keep}, {constrain(tfield, adj, ua)} AS {t} FROM {last_})")
    return ctes, tag


def chain_sql(base_sql: str, columns: list[str], kinds: dict, rules, spec, by, table: str, key: str,
              out_cols: list[str], fill_median: bool = True) -> str:
    ctes = [f"r0 AS ({base_sql})"]
    cur = "r0"
    cols = list(columns)
    for k, rule in enumerate(rules):
        more, cur2 = rule_ctes(cur, cols, kinds, rule, spec.field(rule.target), k, by, table, key, f"r{k + 1}",
                               fill_median)
        ctes += more
        cols = [c for c in cols if c != rule.target] + [rule.target]
        cur = cur2
    return f"WITH {', '.join(ctes)} SELECT {', '.join(out_cols)} FROM {cur}"


LINE_COLS = [c for c, _ in SCHEMAS["lineitem"]]
LINE_KINDS = {c: k for c, k in SCHEMAS["lineitem"]}
LINE_KEY_SQL = "concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber)"
LK = ", ".join(R.LINE_KEY)


def line_rule_sql(rule, out_cols, extra_sql: str = "", extra_cols=(), by=None, extra_kinds=None) -> str:
    base = f"SELECT *, {LINE_KEY_SQL} AS _k{extra_sql} FROM lineitem"
    kinds = dict(LINE_KINDS, **(extra_kinds or {}))
    return chain_sql(base, LINE_COLS + ["_k"] + list(extra_cols), kinds, [rule], R.LINE_SPEC, by,
                     "lineitem", "_k", [LK] + out_cols)


def rule_chain_sql() -> str:
    buckets = f"CAST(ceil((SELECT count(*) FROM lineitem) / {R.LINE_BATCH_ROWS}) AS BIGINT)"
    batch = f"(CAST(('0x' || substr(md5({LINE_KEY_SQL}), 1, 8)) AS BIGINT) % greatest({buckets}, 1))"
    base = (f"SELECT *, {LINE_KEY_SQL} AS _k, false AS is_large, "
            f"{batch} AS _batch FROM lineitem")
    kinds = dict(LINE_KINDS, is_large="b")
    return chain_sql(base, LINE_COLS + ["_k", "is_large", "_batch"], kinds, CHAIN_RULES, R.LINE_SPEC,
                     ["_batch"], "lineitem", "_k", [LK, "l_extendedprice", "l_tax", "is_large"])


def whole_table_rules_sql() -> str:
    base = (f"SELECT * REPLACE (CASE WHEN l_returnflag <> 'R' THEN l_tax END AS l_tax, "
            f"CASE WHEN l_linestatus = 'O' THEN l_extendedprice END AS l_extendedprice), {LINE_KEY_SQL} AS _k FROM lineitem")
    return chain_sql(base, LINE_COLS + ["_k"], LINE_KINDS, WHOLE_TABLE_RULES, R.LINE_SPEC, None,
                     "lineitem", "_k", [LK, "l_extendedprice", "l_tax"])


def parent_influence_sql() -> str:
    ov = "OVER ()"
    key = "o_orderkey"
    spec = R.ORDERS_SPEC
    base = ("SELECT o_orderkey, o_custkey, o_totalprice, (o_orderpriority = '1-URGENT') AS priority_flag, "
            "(o_totalprice * CAST('0.01' AS DOUBLE)) AS ship_cost, c_acctbal AS o_custkey__tenure, "
            "c_nationkey AS o_custkey__comorbidity_count FROM orders JOIN customer ON o_custkey = c_custkey")
    f = spec.field
    d1 = "coalesce(" + as_double("o_custkey__tenure") + f", {dbl(0.0)})"
    b0 = f"coalesce({as_double('o_totalprice')}, {dbl(0.0)})"
    b1 = f"coalesce({as_double('ship_cost')}, {dbl(0.0)})"
    z1 = safe_z("__d", "__dm", "__dd")
    adj = lambda b, s, strength: f"(({b}) + (({dbl(strength)} * {z1}) * {std1(s)}))"
    p = f"greatest({dbl(0.05)}, least({dbl(0.95)}, ({dbl(0.5)} + ({dbl(0.2)} * {z1}))))"
    s1 = (f"s1 AS (SELECT *, avg(__d) {ov} AS __dm, stddev_samp(__d) {ov} AS __dd, "
          f"stddev_samp(__b0) {ov} AS __bs0, stddev_samp(__b1) {ov} AS __bs1 FROM "
          f"(SELECT *, {d1} AS __d, {b0} AS __b0, {b1} AS __b1 FROM base))")
    p1 = (f"p1 AS (SELECT o_orderkey, o_custkey__comorbidity_count, "
          f"{constrain(f('o_totalprice'), adj('__b0', '__bs0', 0.28), None)} AS o_totalprice, "
          f"({u('orders', 'priority_flag#parent', key)} < {p}) AS priority_flag, "
          f"{constrain(f('ship_cost'), adj('__b1', '__bs1', 0.28), None)} AS ship_cost FROM s1)")
    d2 = "coalesce(" + as_double("o_custkey__comorbidity_count") + f", {dbl(0.0)})"
    s2 = (f"s2 AS (SELECT *, avg(__d) {ov} AS __dm, stddev_samp(__d) {ov} AS __dd, "
          f"stddev_samp(__b0) {ov} AS __bs0 FROM (SELECT *, {d2} AS __d, {b1.replace('ship_cost', 'ship_cost')} AS __b0 FROM p1))")
    out = (f"SELECT o_orderkey, o_totalprice, priority_flag, "
           f"{constrain(f('ship_cost'), adj('__b0', '__bs0', 0.24), None)} AS ship_cost FROM s2")
    return f"WITH base AS ({base}), {s1}, {p1}, {s2} {out}"


# ---------------------------------------------------------------------------
# Metrics.

def null_like(col: str, kind: str) -> str:
    return f"({col} IS NULL OR isnan({col}))" if kind == "f" else f"({col} IS NULL)"


def nan_null(col: str, kind: str) -> str:
    return f"(CASE WHEN isnan({col}) THEN NULL ELSE {col} END)" if kind == "f" else col


def quality_report_sql(tables) -> str:
    parts = []
    for tname in tables:
        cols = SCHEMAS[tname]
        for c, k in cols:
            parts.append(
                f"SELECT {q(tname)} AS table_name, {q(c)} AS column_name, "
                f"round(coalesce(avg(CAST({null_like(c, k)} AS DOUBLE)), {dbl(0.0)}), 6) AS null_fraction, "
                f"CAST(count(DISTINCT {nan_null(c, k)}) AS BIGINT) AS distinct_count, "
                f"CAST(count(*) AS BIGINT) AS rows, CAST({len(cols)} AS BIGINT) AS columns, "
                f"CAST({len(tables)} AS BIGINT) AS table_count FROM {tname}")
    return " UNION ALL ".join(parts)


def corr_sql(source: str, cols) -> str:
    parts = []
    for i, j in combinations_with_replacement(range(len(cols)), 2):
        pairs = {(i, j), (j, i)}
        for a, b in sorted(pairs):
            parts.append(f"SELECT {q(cols[a])} AS col_a, {q(cols[b])} AS col_b, "
                         f"round(corr(CAST({cols[i]} AS DOUBLE), CAST({cols[j]} AS DOUBLE)), 4) AS corr FROM {source}")
    return " UNION ALL ".join(parts)


def fk_sql(child, fk, parent, ref) -> str:
    return (f"SELECT {q(child)} AS child_table, {q(fk)} AS fk_column, {q(parent)} AS parent_table, "
            f"{q(ref)} AS parent_column, CAST(count(*) AS BIGINT) AS child_distinct, "
            f"CAST(coalesce(sum(CASE WHEN p.k IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS missing_distinct, "
            f"CASE WHEN count(*) = 0 THEN {dbl(1.0)} ELSE round({dbl(1.0)} - "
            f"CAST(coalesce(sum(CASE WHEN p.k IS NULL THEN 1 ELSE 0 END), 0) AS DOUBLE) / count(*), 4) END AS valid_fk_rate "
            f"FROM (SELECT DISTINCT {fk} AS k FROM {child} WHERE {fk} IS NOT NULL) c "
            f"LEFT JOIN (SELECT DISTINCT {ref} AS k FROM {parent}) p ON c.k = p.k")


def schema_profile_sql() -> str:
    names = list(SCHEMAS)
    total_cols = sum(len(SCHEMAS[n]) for n in names)
    tier = "small" if total_cols < 50 else ("medium" if total_cols < 200 else "large")
    parts = []
    for n in names:
        dates = ",".join(c for c, k in SCHEMAS[n] if k == "t")
        pii = ",".join(c for c, _ in SCHEMAS[n] if f"{n}.{c}" in {"customer.c_name"})
        nfk = sum(1 for e in R.FK_EDGES if e[0] == n)
        parts.append(f"SELECT {q(n)} AS table_name, CAST(count(*) AS BIGINT) AS rows, "
                     f"CAST({len(SCHEMAS[n])} AS BIGINT) AS columns, CAST({nfk} AS BIGINT) AS foreign_keys, "
                     f"{q(dates)} AS date_columns, {q(pii)} AS pii_columns, CAST({len(names)} AS BIGINT) AS total_tables, "
                     f"CAST({total_cols} AS BIGINT) AS total_columns, CAST({len(R.FK_EDGES)} AS BIGINT) AS foreign_key_count, "
                     f"{q(tier)} AS size_tier FROM {n}")
    return " UNION ALL ".join(parts)


def people_sql() -> str:
    key = "c_custkey"
    return (f"SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, "
            f"concat_ws(' ', {first('people', 'patient_name', key)}, {last('people', 'patient_name', key)}) AS patient_name, "
            f"{email('people', 'email', key)} AS email, {digits(u('people', 'zip_code', key), 5)} AS zip_code FROM customer")


def sha(col: str) -> str:
    return f"sha256(CAST({col} AS VARCHAR))"


def masked(col: str) -> str:
    low = col.lower()
    if "email" in low:
        return f"('user+' || substr({sha(col)}, 1, 12) || '@example.com')"
    if "zip" in low or "postal" in low:
        return f"(substr(CAST({col} AS VARCHAR), 1, 3) || 'XX')"
    return sha(col)


def gen_sql(fields, table: str, source: str, key_expr: str, rows_sql: str | None = None,
            batched_sql: str | None = None) -> str:
    cols = ", ".join(f"{gen_field(f, table, '_row')} AS {f.name}" for f in fields)
    return f"SELECT _row AS id, {cols} FROM (SELECT {key_expr} AS _row FROM {source})"


def gen_temporal_sql() -> str:
    """The Spark side reads the row count first; here the count is a subquery."""
    n = "(SELECT count(*) FROM orders)"
    cols = [f"{gen_field(f, 'visits', '_row', rows=n, batched=True)} AS {f.name}" for f in R.TEMPORAL]
    return f"SELECT _row AS id, {', '.join(cols)} FROM (SELECT o_orderkey + 1 AS _row FROM orders)"


def gen_temporal_exact_sql() -> str:
    """Ordered columns: the batch's draws sorted and dealt by position."""
    size = R.VISIT_BATCH
    base = (f"SELECT o_orderkey + 1 AS _row, o_orderkey // {size} AS b, o_orderkey % {size} AS p, "
            f"{u('visits', 'signup_date', '(o_orderkey + 1)')} AS u1, {u('visits', 'created_at', '(o_orderkey + 1)')} AS u2 FROM orders")
    rank = lambda c: f"(SELECT b, row_number() OVER (PARTITION BY b ORDER BY {c}) - 1 AS p, {c} AS s FROM r)"
    plain = {f.name: gen_field(f, "visits", "_row") for f in R.TEMPORAL}
    epoch = epoch_of(AS_OF)
    return (f"WITH r AS ({base}) SELECT _row AS id, {plain['service_date']} AS service_date, "
            f"(DATE '{AS_OF.date().isoformat()}' - CAST(729 - floor(x.s * 730) AS INTEGER)) AS signup_date, "
            f"{plain['visit_time']} AS visit_time, (TIMESTAMP '1970-01-01 00:00:00' + to_seconds({epoch} - "
            f"CAST(8759 - floor(y.s * 8760) AS BIGINT) * 3600)) AS created_at "
            f"FROM r JOIN {rank('u1')} x ON r.b = x.b AND r.p = x.p JOIN {rank('u2')} y ON r.b = y.b AND r.p = y.p")


def visits_sql() -> str:
    """CTEs ``pat`` and the visits generated over orders (G1-G4, G12-G19, D8-D10, D5 with the
    name-derived rule set), with customers as parents."""
    from rowsmith.spec import load_spec
    cl = load_spec(R.CUSTOMER_VISITS).table("visits")
    n_par, n_cl = "(SELECT count(*) FROM customer)", "(SELECT count(*) FROM orders)"
    ctes = ["pat AS (SELECT c_custkey, c_acctbal AS tenure, c_nationkey AS comorbidity_count, "
            "row_number() OVER (ORDER BY c_custkey) AS _idx FROM customer)"]
    gen = []
    for f in cl.fields:
        if f.name == "id":
            gen.append("_row AS id")
        elif f.name == "customer_id":
            gen.append(f"CAST((floor({u('visits', 'customer_id#fk', '_row')} * {n_par}) + 1) AS BIGINT) AS _pidx")
        else:
            gen.append(f"{gen_field(f, 'visits', '_row', rows=n_cl, batched=True, batch_rows=R.VISIT_BATCH)} AS {f.name}")
    ctes.append(f"c0 AS (SELECT _row, CAST(floor((_row - 1) / {R.VISIT_BATCH}) AS BIGINT) AS _batch, {', '.join(gen)} FROM "
                f"(SELECT o_orderkey + 1 AS _row FROM orders))")
    ctes.append("c1 AS (SELECT c0.*, pat.c_custkey AS customer_id, pat.tenure AS customer_id__tenure, "
                "pat.comorbidity_count AS customer_id__comorbidity_count FROM c0 JOIN pat ON c0._pidx = pat._idx)")
    ov = "OVER (PARTITION BY _batch)"
    z = safe_z("__d", "__dm", "__dd")

    def shift(src_cte, out_cte, driver, targets, strength, tag):
        base = ", ".join(f"coalesce({as_double(t)}, {dbl(0.0)}) AS __b{i}" for i, t in enumerate(targets))
        sds = ", ".join(f"stddev_samp(__b{i}) {ov} AS __bs{i}" for i in range(len(targets)))
        staged = (f"SELECT *, avg(__d) {ov} AS __dm, stddev_samp(__d) {ov} AS __dd, {sds} FROM "
                  f"(SELECT *, coalesce({as_double(driver)}, {dbl(0.0)}) AS __d, {base} FROM {src_cte})")
        keep = ["_row", "_batch", "id", "customer_id", "length_of_stay", "cost", "readmission_risk_score",
                "visit_date", "customer_id__tenure", "customer_id__comorbidity_count"]
        outs = []
        for c in keep:
            if c in targets:
                i = targets.index(c)
                adj = f"(__b{i} + (({dbl(strength)} * {z}) * {std1(f'__bs{i}')}))"
                outs.append(f"{constrain(cl.field(c), adj, None)} AS {c}")
            else:
                outs.append(c)
        return f"{out_cte} AS (SELECT {', '.join(outs)} FROM ({staged}))"

    ctes.append(shift("c1", "c2", "customer_id__tenure", ["length_of_stay", "cost", "readmission_risk_score"], 0.28, "parent"))
    ctes.append(shift("c2", "c3", "customer_id__comorbidity_count", ["length_of_stay", "cost", "readmission_risk_score"],
                      0.24, "comorb"))
    cols = ["_row", "_batch", "id", "customer_id", "length_of_stay", "cost", "readmission_risk_score", "visit_date"]
    rules = VISIT_RULES
    chain = chain_sql("SELECT * FROM c3", cols, {c: ("f" if c in ("cost", "readmission_risk_score") else "i") for c in cols},
                      rules, cl, ["_batch"], "visits", "_row", ["id", "customer_id", "length_of_stay", "cost",
                                                                "readmission_risk_score", "visit_date"],
                      fill_median=False)
    # chain_sql returns "WITH r0 AS (...), ... SELECT ..."; splice it behind our CTEs
    return "WITH " + ", ".join(ctes) + ", " + chain[len("WITH "):]


def oracle_queries() -> dict:
    out = {}
    out["segment_order_value"] = (
        "SELECT c_mktsegment, round(avg(o_totalprice), 6) AS avg_o_totalprice, count(*) AS row_count "
        "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
    out["gold_summary_orders"] = (
        "SELECT o_orderstatus, round(avg(o_custkey), 6) AS avg_o_custkey, round(avg(o_totalprice), 6) AS avg_o_totalprice, "
        "count(*) AS row_count FROM orders GROUP BY o_orderstatus")
    out["gold_join_orders_customer"] = (
        "SELECT o_orderstatus, round(avg(o_custkey), 6) AS avg_o_custkey, round(avg(o_totalprice), 6) AS avg_o_totalprice, "
        "round(avg(c_nationkey), 6) AS avg_c_nationkey, round(avg(c_acctbal), 6) AS avg_c_acctbal, count(*) AS row_count "
        "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderstatus")
    out["global_avg_lineitem"] = (
        "SELECT round(avg(l_quantity), 6) AS avg_l_quantity, round(avg(l_extendedprice), 6) AS avg_l_extendedprice, "
        "round(avg(l_discount), 6) AS avg_l_discount, round(avg(l_tax), 6) AS avg_l_tax, count(*) AS row_count FROM lineitem")
    out["silver_dedupe_lineitem"] = (
        "SELECT DISTINCT * FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_returnflag = 'R')")
    gaps = ("SELECT * REPLACE (nullif(l_linenumber, 1) AS l_linenumber, CASE WHEN l_quantity > 45 THEN CAST('NaN' AS DOUBLE) "
            "ELSE l_quantity END AS l_quantity, nullif(l_returnflag, 'R') AS l_returnflag) FROM lineitem")
    gap_cols = SCHEMAS["lineitem"]
    out["null_fraction"] = " UNION ALL ".join(
        f"SELECT 'lineitem' AS table_name, {q(c)} AS column_name, "
        f"round(coalesce(avg(CAST({null_like(c, k)} AS DOUBLE)), {dbl(0.0)}), 6) AS null_fraction FROM ({gaps})"
        for c, k in gap_cols)
    out["distinct_counts"] = " UNION ALL ".join(
        f"SELECT 'customer' AS table_name, {q(c)} AS column_name, "
        f"CAST(count(DISTINCT {nan_null(c, k)}) AS BIGINT) AS distinct_count FROM customer"
        for c, k in SCHEMAS["customer"])
    out["corr_matrix_lineitem"] = corr_sql(
        "(SELECT * REPLACE (CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS l_quantity) FROM lineitem)",
        [c for c, k in SCHEMAS["lineitem"] if k in "if"])
    inc = corr_sql("(SELECT * REPLACE (nullif(l_linenumber, 1) AS l_linenumber, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity "
                   "END AS l_quantity) FROM lineitem)", [c for c, k in SCHEMAS["lineitem"] if k in "if"])
    out["corr_incremental_lineitem"] = f"SELECT x.*, (SELECT CAST(count(*) AS BIGINT) FROM lineitem) AS rows FROM ({inc}) x"
    jc = corr_sql("(SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)",
                  ["o_totalprice", "c_acctbal", "c_nationkey"])
    out["joined_corr"] = (f"SELECT x.*, (SELECT CAST(count(*) AS BIGINT) FROM orders JOIN customer "
                          f"ON o_custkey = c_custkey) AS joined_row_count FROM ({jc}) x")
    out["fk_integrity"] = " UNION ALL ".join(fk_sql(*e) for e in R.FK_EDGES)
    out["quality_report"] = quality_report_sql(list(SCHEMAS))
    out["quality_sketches"] = (f"SELECT table_name, column_name, null_fraction, rows, distinct_count, true AS near "
                               f"FROM ({quality_report_sql(list(SCHEMAS))}) WHERE column_name <> 'l_returnflag'")
    out["schema_profile"] = schema_profile_sql()
    ppl = people_sql()
    out["pattern_pass_rates"] = (
        f"WITH p AS ({ppl}) "
        f"SELECT 'zip_5_digits' AS check_name, round(avg(CAST(coalesce(regexp_matches(zip_code, '^\\d{{5}}$'), false) AS DOUBLE)), 6) AS pass_rate FROM p "
        f"UNION ALL SELECT 'name_has_space', round(avg(CAST(coalesce(contains(patient_name, ' '), false) AS DOUBLE)), 6) FROM p "
        f"UNION ALL SELECT 'email_has_at', round(avg(CAST(coalesce(contains(email, '@'), false) AS DOUBLE)), 6) FROM p "
        f"UNION ALL SELECT 'customer_name_format', round(avg(CAST(coalesce(regexp_matches(c_name, '^Customer#\\d{{9}}$'), false) AS DOUBLE)), 6) FROM p"
        + "".join(f" UNION ALL SELECT {q(n)}, round(avg(CAST(coalesce({x}, false) AS DOUBLE)), 6) FROM p" for n, x in (
            ("nation_known", "c_nationkey BETWEEN 0 AND 24"), ("balance_positive", "c_acctbal > 0"),
            ("segment_upper", "regexp_matches(c_mktsegment, '^[A-Z]+$')"), ("key_positive", "c_custkey > 0"))))
    out["mask_customer"] = (
        f"WITH p AS ({ppl}) SELECT c_custkey, {masked('c_name')} AS c_name, c_nationkey, c_acctbal, c_mktsegment, "
        f"{masked('patient_name')} AS patient_name, {masked('email')} AS email, {masked('zip_code')} AS zip_code FROM p")
    out["mask_audit"] = f"WITH p AS ({ppl}) " + " UNION ALL ".join(
        f"SELECT {q(c)} AS column_name, CAST(coalesce(sum(CAST({masked(c)} = CAST({c} AS VARCHAR) AS BIGINT)), 0) AS BIGINT) AS unchanged_rows, "
        f"CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_raw, CAST(count(DISTINCT {masked(c)}) AS BIGINT) AS distinct_masked FROM p"
        for c in R.PII_COLUMNS)
    raw_q = "CASE WHEN l_returnflag = 'N' THEN 'bad' ELSE CAST(l_quantity * 1.5 AS VARCHAR) END"
    out["repair_int"] = (f"SELECT {LK}, {repair_int(raw_q, 1, 50)} AS qty_fixed, "
                         f"{repair_int('l_extendedprice / 100', None, 500)} AS price_units FROM lineitem")
    raw_f = "CASE WHEN l_returnflag = 'A' THEN CAST('NaN' AS DOUBLE) ELSE l_extendedprice * (1 - l_discount) END"
    out["repair_float"] = (f"SELECT {LK}, {repair_float(raw_f, 1000.0, 50000.0)} AS net_fixed, "
                           f"{repair_float('CAST(l_tax AS VARCHAR)', None, 0.05)} AS tax_fixed FROM lineitem")
    out["repair_allowed"] = (
        f"SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus "
        f"ELSE {pick(u('orders', 'o_orderstatus#allowed', 'o_orderkey'), ['F', 'O'])} END AS o_orderstatus FROM orders")
    lim = R.LINE_LIMITS
    fixed = {c: constrain(lim.field(c), c, u("lineitem", f"{c}#allowed", "_k")) for c in
             ("l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_tax")}
    out["enforce_constraints"] = (
        f"SELECT l_orderkey, l_partkey, l_suppkey, {fixed['l_linenumber']} AS l_linenumber, "
        f"{fixed['l_quantity']} AS l_quantity, {fixed['l_discount']} AS l_discount, "
        f"{fixed['l_returnflag']} AS l_returnflag, {fixed['l_tax']} AS l_tax "
        f"FROM (SELECT *, {LINE_KEY_SQL} AS _k FROM lineitem)")
    out["conform_events"] = ("SELECT event_id, ts, user_id, event_type, value, props, "
                             "CAST(NULL AS VARCHAR) AS session_id FROM events")
    hours = f"CAST((1 + floor({u('lineitem', 'l_shipdate#order', '_k')} * 95)) AS BIGINT)"
    out["repair_temporal"] = (
        f"SELECT {LK}, o_orderdate, CASE WHEN l_shipdate < o_orderdate THEN o_orderdate + to_hours({hours}) "
        f"ELSE l_shipdate END AS l_shipdate FROM (SELECT *, {LINE_KEY_SQL} AS _k FROM lineitem "
        f"JOIN orders ON l_orderkey = o_orderkey)")
    zs = safe_z("__s", "avg(__s) OVER ()", "stddev_samp(__s) OVER ()")
    out["zscore"] = (f"SELECT {LK}, round({zs}, 6) AS l_quantity_z FROM (SELECT *, "
                     f"coalesce({as_double('l_quantity')}, {dbl(0.0)}) AS __s FROM lineitem)")
    out["num_num"] = line_rule_sql(Rule("l_quantity", "l_extendedprice", "num_num", 0.35),
                                   ["l_extendedprice"])
    out["flag_num"] = line_rule_sql(Rule("is_returned", "l_extendedprice", "bool_num", 0.22),
                                    ["l_extendedprice"], ", (l_returnflag = 'R') AS is_returned", ["is_returned"],
                                    extra_kinds={"is_returned": "b"})
    out["num_flag"] = line_rule_sql(Rule("l_quantity", "is_large", "num_bool", 0.42), ["is_large"],
                                    ", false AS is_large", ["is_large"], extra_kinds={"is_large": "b"})
    out["rule_chain"] = rule_chain_sql()
    out["whole_table_rules"] = whole_table_rules_sql()
    out["parent_influence"] = parent_influence_sql()
    out["ttl_filter"] = "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-15 11:00:00'"
    n = "(SELECT count(*) FROM customer)"
    fk_u = u("claims", "patient_id#fk", "_row")
    out["gen_keys_fk"] = (
        f"SELECT c.id, p.c_custkey AS patient_id FROM "
        f"(SELECT _row AS id, CAST((floor({fk_u} * {n}) + 1) AS BIGINT) AS _pidx FROM "
        f"(SELECT o_orderkey + 1 AS _row FROM orders)) c JOIN "
        f"(SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS _idx FROM customer) p ON c._pidx = p._idx")
    out["gen_ints_floats"] = gen_sql(R.NUMBERS, "numbers", "orders", "o_orderkey + 1")
    out["gen_text"] = gen_sql(R.TEXT, "people", "customer", "c_custkey + 1")
    out["gen_flags"] = gen_sql(R.FLAGS, "visits", "orders", "o_orderkey + 1")
    out["gen_temporal"] = gen_temporal_sql()
    out["gen_temporal_exact"] = gen_temporal_exact_sql()
    hc = visits_sql()
    out["gen_claims"] = hc
    cut = hc.rindex(" SELECT ")
    cols = ["tenure", "cost", "length_of_stay", "comorbidity_count", "readmission_risk_score"]
    out["gen_star_schema"] = (
        f"{hc[:cut]}, cl AS ({hc[cut + 1:]}), j AS (SELECT cl.*, pat.tenure, pat.comorbidity_count FROM cl "
        f"JOIN pat ON cl.customer_id = pat.c_custkey) SELECT x.*, (SELECT CAST(count(*) AS BIGINT) FROM j) AS joined_row_count "
        f"FROM ({corr_sql('j', cols)}) x")
    out["sample_rows"] = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20"
    out["csv_roundtrip"] = "SELECT * FROM lineitem"
    for name in ("documents", "pages", "conversations", "events"):
        out[f"csv_{name}"] = f"SELECT * FROM {name}"
    out["parquet_roundtrip"] = "SELECT * FROM orders"
    out["json_scan"] = "SELECT * FROM events"
    out["compact_lineitem"] = "SELECT * FROM lineitem"
    out["event_json_roundtrip"] = "SELECT * FROM events"
    out["stream_silver"] = "SELECT * FROM events"
    out["compact_in_place_lineitem"] = "SELECT * FROM lineitem"
    out["ttl_purge"] = out["ttl_filter"]
    out["evolve_orders"] = ("SELECT * REPLACE (CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' THEN o_orderpriority END "
                            "AS o_orderpriority) FROM orders")
    out["catalog_orders"] = "SELECT * FROM orders"
    out["stream_publish"] = "SELECT * FROM events"
    out["pii_inventory"] = f"WITH p AS ({ppl}) " + " UNION ALL ".join(
        f"SELECT 'customer' AS table_name, {q(c)} AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count, "
        f"CAST(count(*) AS BIGINT) AS rows FROM p" for c in ("c_name", "patient_name", "email", "zip_code"))
    key = "c_custkey"
    out["scaled_rows"] = (
        f"SELECT c_custkey, concat_ws(' ', {first('customer', 'patient_name', key)}, {last('customer', 'patient_name', key)}) AS patient_name, "
        f"{email('customer', 'email', key)} AS email, {digits(u('customer', 'zip_code', key), 5)} AS zip_code "
        f"FROM (SELECT unnest(range(1, CAST(floor((SELECT count(*) FROM customer) * 2.5) AS BIGINT) + 1)) AS c_custkey)")
    out["medallion_gold"] = out["gold_join_orders_customer"]
    return out
