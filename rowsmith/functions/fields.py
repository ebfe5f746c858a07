"""Column builders for generated fields.

``field_column`` picks a generator from a field's allowed values, provider name,
column name and type, in this order: allowed values, named provider, ``email``,
``name``, ``zip``/``postal``, ``phone``, string containing ``id`` (UUID), then by
type (integer, float, boolean, date, datetime), then string sub-rules
(``status``, ``country``, ``city``, any word). Name tests are lower-cased
substring tests and come before the type, so an integer called
``tournament_size`` gets a person name; pass ``exact_names=True`` to apply the
text rules to string fields only.

Every builder is a native expression over the row key: no Python runs per row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field as dc_field
from datetime import date, datetime, timezone

from pyspark.sql import Column, Window, functions as F

from rowsmith.functions import pools, rng
from rowsmith.spec import FieldSpec

DAYS_BACK = 730          # dates: as_of - U{0..729} days
HOURS_BACK = 24 * 365    # timestamps: as_of - U{0..8759} hours

# Name keywords that select a distribution or an ordering.
POISSON_WORDS = ("count", "qty", "quantity")
BETA_WORDS = ("score", "probability", "rate", "ratio")
AMOUNT_WORDS = ("amount", "price", "cost", "value")
RARE_FLAG_WORDS = ("fraud", "risk", "abnormal")
ORDERED_DATE_WORDS = ("created", "start", "signup", "opened")
ORDERED_TS_WORDS = ("created", "event", "timestamp", "occurred", "updated")
BETA_A, BETA_B = 2.2, 3.6
LOGNORMAL_SIGMA = 0.85
RARE_FLAG_P, FLAG_P = 0.18, 0.5
INT_DEFAULT = (0, 10000)
FLOAT_DEFAULT = (0.0, 1000.0)


def default_as_of() -> datetime:
    """Current UTC time to the second, as a naive UTC datetime."""
    return datetime.now(timezone.utc).replace(microsecond=0, tzinfo=None)


@dataclass(frozen=True)
class GenContext:
    """Everything a field builder needs besides the field itself.

    Draw hashes are *bound*: each (column tag) hash becomes one hidden column
    (``bound``), computed in a projection before the generators, which then only
    reference it. Catalyst keeps a non-cheap expression that is referenced many
    times in its own projection, so the md5 runs once per row and tag, and the
    generator code stays small enough for the JIT (a Poisson column compares its
    draw with ~60 constants). Call ``prepare(df)`` before selecting the fields and
    ``finish(df)`` after."""
    table: str
    seed: int = 42
    as_of: datetime = dc_field(default_factory=default_as_of)
    mode: str = "portable"
    rows: int = 0                # total rows (row-ordered temporal columns)
    batch_rows: int = 25_000
    batched: bool = False
    row_col: str = "_row"        # dense 1..rows
    exact_names: bool = False
    ordered: bool = True         # row-ordered temporal columns (off for streams)
    exact: bool = False          # ordered columns by sorting each batch's draws, not by strata
    bound: dict = dc_field(default_factory=dict, compare=False)
    sorted_draws: dict = dc_field(default_factory=dict, compare=False)

    def _bind(self, tag: str, expr: Column) -> Column:
        name = self.bound.get(tag, (None,))[0]
        if name is None:
            name = f"__h{len(self.bound)}_{self.table}"
            self.bound[tag] = (name, expr)
        return F.col(name)

    def hex(self, column: str) -> Column:
        """md5 hex digest for a column tag (bound once per row)."""
        return self._bind(f"hex|{column}", rng.hash_hex(self.row_col, self.seed, self.table, column))

    def bits(self, column: str, draw: int = 0) -> Column:
        """52-bit integer of a draw, bound as its own column (the md5 of both draws of
        a tag is shared by subexpression elimination within that projection)."""
        expr = rng.uniform_bits(self.row_col, self.seed, self.table, column, draw, self.mode)
        return self._bind(f"bits|{column}|{draw}", expr)

    def u(self, column: str, draw: int = 0) -> Column:
        return self.bits(column, draw) / F.lit(rng.TWO52)

    def u_name(self, column: str, draw: int = 0) -> str:
        """Name of a bound column holding the uniform double of a draw."""
        self._bind(f"u|{column}|{draw}", self.u(column, draw))
        return self.bound[f"u|{column}|{draw}"][0]

    def u_open(self, column: str, draw: int = 0) -> Column:
        return (self.bits(column, draw) + F.lit(1)) / F.lit(rng.TWO52)

    def normal(self, column: str) -> Column:
        return (F.sqrt(F.lit(-2.0) * F.log(self.u_open(column, 0)))
                * F.cos(F.lit(2.0 * math.pi) * self.u(column, 1)))

    def prepare(self, df):
        """Add the bound columns the field expressions built so far refer to: draw
        bits first, then the uniforms derived from them (two projections)."""
        bits = {n: e for tag, (n, e) in self.bound.items() if not tag.startswith("u|")}
        us = {n: e for tag, (n, e) in self.bound.items() if tag.startswith("u|")}
        df = df.withColumns(bits)
        df = df.withColumns(us) if us else df
        return with_sorted_draws(df, self) if self.sorted_draws else df

    def finish(self, df):
        return df.drop(*[name for name, _ in self.bound.values()], *self.sorted_draws.values())

    def sorted_u(self, column: str) -> Column:
        """The i-th smallest of the batch's draws of a column for the batch's i-th row."""
        name = self.sorted_draws.setdefault(self.u_name(column), f"__s{len(self.sorted_draws)}_{self.table}")
        return F.col(name)

    def place(self) -> tuple[Column, Column]:
        """A row's batch and its position there, from 0."""
        row0 = F.col(self.row_col) - F.lit(1)
        if not self.batched:
            return F.lit(0).cast("long"), row0
        return F.floor(row0 / F.lit(self.batch_rows)).cast("long"), F.pmod(row0, F.lit(self.batch_rows))


def with_sorted_draws(df, ctx: GenContext):
    """Adds the sorted draws: each batch's draws are ranked (at most ``batch_rows`` a group) and joined to the rows by
    (batch, position). All columns share one ranking pass and one join."""
    batch, place = ctx.place()
    rows = df.withColumn("__batch", batch).withColumn("__place", place)
    draws = list(ctx.sorted_draws)
    each = rows.select("__batch", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(u).alias("u"))
                                                      for i, u in enumerate(draws)])).alias("d")).select("__batch", "d.*")
    ranked = each.withColumn("__place", F.row_number().over(Window.partitionBy("__batch", "i").orderBy("u")).cast("long") - 1)
    wide = ranked.groupBy(F.col("__batch").alias("__b"), F.col("__place").alias("__p")).agg(*[
        F.max(F.when(F.col("i") == i, F.col("u"))).alias(ctx.sorted_draws[u]) for i, u in enumerate(draws)])
    return rows.join(wide, (F.col("__batch") == F.col("__b")) & (F.col("__place") == F.col("__p"))).drop(
        "__batch", "__place", "__b", "__p")


def _bounds(f: FieldSpec, default):
    lo = f.min_value if f.min_value is not None else default[0]
    hi = f.max_value if f.max_value is not None else default[1]
    return lo, hi


def int_column(f: FieldSpec, ctx: GenContext) -> Column:
    name = f.name.lower()
    lo, hi = (int(v) for v in _bounds(f, INT_DEFAULT))
    if any(k in name for k in POISSON_WORDS):
        lam = max(2.0, min(20.0, (hi - lo) / 6 if hi > lo else 3.0))
        val = rng.poisson(ctx.u_name(f.name), lam) + F.lit(lo)
        return F.least(F.greatest(val, F.lit(lo)), F.lit(max(lo + 1, hi))).cast("long")
    width = max(lo + 1, hi + 1) - lo
    return (F.lit(lo) + F.floor(ctx.u(f.name) * F.lit(width))).cast("long")


def float_column(f: FieldSpec, ctx: GenContext) -> Column:
    name = f.name.lower()
    lo, hi = (float(v) for v in _bounds(f, FLOAT_DEFAULT))
    if any(k in name for k in BETA_WORDS):
        v = rng.beta(ctx.u(f.name), BETA_A, BETA_B)
        if hi > lo:
            v = F.lit(lo) + v * F.lit(hi - lo)
        return F.round(v, 4)
    if any(k in name for k in AMOUNT_WORDS):
        scale = max((hi - lo) / 4 if hi > lo else 1.0, 1.0)
        v = F.lit(scale) * F.exp(F.lit(LOGNORMAL_SIGMA) * ctx.normal(f.name)) + F.lit(lo)
        v = F.greatest(v, F.lit(lo))
        if hi > lo:
            v = F.least(v, F.lit(hi))
        return F.round(v, 2)
    if hi <= lo:
        return F.lit(lo).cast("double")
    return F.round(F.lit(lo) + ctx.u(f.name) * F.lit(hi - lo), 4)


def bool_column(f: FieldSpec, ctx: GenContext) -> Column:
    name = f.name.lower()
    p = RARE_FLAG_P if any(k in name for k in RARE_FLAG_WORDS) else FLAG_P
    return ctx.u(f.name) < F.lit(p)


def _position(ctx: GenContext, column: str) -> Column:
    """Stratified position in [0, 1) of a row inside its batch: monotone in the row key.

    Sorting n uniform draws and handing the i-th smallest to row i is, in law, the
    same as one draw per stratum [i/n, (i+1)/n); this needs no sort and no shuffle. With ``exact`` the
    draws of a batch are in fact sorted."""
    if ctx.exact:
        return ctx.sorted_u(column)
    row0 = F.col(ctx.row_col) - F.lit(1)
    n = max(int(ctx.rows), 1)
    if ctx.batched:
        b = ctx.batch_rows
        i = F.pmod(row0, F.lit(b))
        start = row0 - i
        nb = F.least(F.lit(b), F.lit(n) - start)
    else:
        i, nb = row0, F.lit(n)
    return (i + ctx.u(column)) / nb


def date_column(f: FieldSpec, ctx: GenContext) -> Column:
    name = f.name.lower()
    base = ctx.as_of.date() if isinstance(ctx.as_of, datetime) else ctx.as_of
    if ctx.ordered and any(k in name for k in ORDERED_DATE_WORDS):
        back = F.lit(DAYS_BACK - 1) - F.floor(_position(ctx, f.name) * F.lit(DAYS_BACK))
    else:
        back = F.floor(ctx.u(f.name) * F.lit(DAYS_BACK))
    return F.date_sub(F.lit(base), back.cast("int"))


def _epoch(ts: datetime) -> int:
    return int(ts.replace(tzinfo=timezone.utc).timestamp())


def datetime_column(f: FieldSpec, ctx: GenContext) -> Column:
    name = f.name.lower()
    as_of = ctx.as_of if isinstance(ctx.as_of, datetime) else datetime(ctx.as_of.year, ctx.as_of.month, ctx.as_of.day)
    if ctx.ordered and any(k in name for k in ORDERED_TS_WORDS):
        back = F.lit(HOURS_BACK - 1) - F.floor(_position(ctx, f.name) * F.lit(HOURS_BACK))
    else:
        back = F.floor(ctx.u(f.name) * F.lit(HOURS_BACK))
    start = F.expr(f"TIMESTAMP_NTZ '{as_of.strftime('%Y-%m-%d %H:%M:%S')}'")
    return start - F.make_dt_interval(F.lit(0), back.cast("int"), F.lit(0), F.lit(0))


def first_name(ctx: GenContext, column: str, draw: int = 0) -> Column:
    return rng.pick(ctx.u(column, draw), pools.FIRST_NAMES)


def last_name(ctx: GenContext, column: str, draw: int = 1) -> Column:
    return rng.pick(ctx.u(column, draw), pools.LAST_NAMES)


def person_name(f: FieldSpec, ctx: GenContext) -> Column:
    return F.concat_ws(" ", first_name(ctx, f.name), last_name(ctx, f.name))


def email(f: FieldSpec, ctx: GenContext) -> Column:
    tag2 = f.name + "#2"
    num = F.floor(ctx.u(tag2, 0) * F.lit(1000)).cast("long").cast("string")
    return F.concat(F.lower(first_name(ctx, f.name)), F.lit("."), F.lower(last_name(ctx, f.name)),
                    num, F.lit("@"), rng.pick(ctx.u(tag2, 1), pools.EMAIL_DOMAINS))


def _digits(u: Column, width: int) -> Column:
    return F.lpad(F.floor(u * F.lit(10 ** width)).cast("long").cast("string"), width, "0")


def zip_code(f: FieldSpec, ctx: GenContext) -> Column:
    return _digits(ctx.u(f.name), 5)


def phone(f: FieldSpec, ctx: GenContext) -> Column:
    tag2 = f.name + "#2"
    area = (F.lit(200) + F.floor(ctx.u(f.name, 0) * F.lit(800))).cast("long").cast("string")
    return F.concat(F.lit("("), area, F.lit(") "), _digits(ctx.u(f.name, 1), 3), F.lit("-"),
                    _digits(ctx.u(tag2, 0), 4))


def uuid4(f: FieldSpec, ctx: GenContext) -> Column:
    """Version-4-shaped identifier from an md5 of the row key (reproducible, unlike uuid())."""
    h = ctx.hex(f.name + "#uuid")
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                       F.concat(F.lit("4"), F.substring(h, 14, 3)),
                       F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def status_values(name: str) -> tuple:
    lname = name.lower()
    for key, vals in pools.STATUS_VALUES:
        if key in lname:
            return vals
    return pools.DEFAULT_STATUS


def word(f: FieldSpec, ctx: GenContext) -> Column:
    return rng.pick(ctx.u(f.name), pools.WORDS)


def city(f: FieldSpec, ctx: GenContext) -> Column:
    return rng.pick(ctx.u(f.name), pools.CITIES)


def country(f: FieldSpec, ctx: GenContext) -> Column:
    return rng.pick(ctx.u(f.name), pools.COUNTRIES)


def company(f: FieldSpec, ctx: GenContext) -> Column:
    return F.concat(last_name(ctx, f.name), F.lit(" "), rng.pick(ctx.u(f.name + "#kind"), pools.COMPANY_KINDS))


def street_address(f: FieldSpec, ctx: GenContext) -> Column:
    number = (F.floor(ctx.u(f.name + "#no") * 9899) + 100).cast("long").cast("string")
    return F.concat(number, F.lit(" "), last_name(ctx, f.name), F.lit(" "), rng.pick(ctx.u(f.name + "#kind"), pools.STREET_KINDS))


def sentence(f: FieldSpec, ctx: GenContext) -> Column:
    picked = [rng.pick(ctx.u(f"{f.name}#{i}"), pools.WORDS) for i in range(6)]
    return F.concat(F.initcap(picked[0]), *[x for w in picked[1:] for x in (F.lit(" "), w)], F.lit("."))


def birth_date(f: FieldSpec, ctx: GenContext) -> Column:
    days = F.floor(ctx.u(f.name) * (90 - 18) * 365.25).cast("int")
    return F.date_sub(F.lit(ctx.as_of.date()), (days + F.lit(int(18 * 365.25) + 1)).cast("int"))


def from_pool(pool) -> object:
    return lambda f, c: rng.pick(c.u(f.name), pool)


# Named providers a field may ask for through ``faker``; unknown names raise.
PROVIDERS = {
    "name": person_name,
    "first_name": lambda f, c: first_name(c, f.name),
    "last_name": lambda f, c: last_name(c, f.name),
    "email": email,
    "zipcode": zip_code,
    "postcode": zip_code,
    "phone_number": phone,
    "uuid4": uuid4,
    "city": city,
    "country": country,
    "word": word,
    "company": company,
    "street_address": street_address,
    "address": street_address,
    "state": from_pool(pools.STATES),
    "job": from_pool(pools.JOBS),
    "currency_code": from_pool(pools.CURRENCIES),
    "sentence": sentence,
    "text": sentence,
    "date_of_birth": birth_date,
}


def field_column(f: FieldSpec, ctx: GenContext) -> Column:
    """Generator expression for one field (see module doc for the dispatch order)."""
    name = f.name.lower()
    text_ok = (not ctx.exact_names) or f.type == "string"
    if f.allowed_values:
        return rng.pick(ctx.u(f.name), f.allowed_values)
    if f.faker:
        if f.faker not in PROVIDERS:
            raise ValueError(f"no provider {f.faker!r} for field {f.name!r}; there are: {', '.join(sorted(PROVIDERS))}")
        return PROVIDERS[f.faker](f, ctx)
    if text_ok and "email" in name:
        return email(f, ctx)
    if text_ok and "name" in name:
        return person_name(f, ctx)
    if text_ok and ("zip" in name or "postal" in name):
        return zip_code(f, ctx)
    if text_ok and "phone" in name:
        return phone(f, ctx)
    if "id" in name and f.type == "string":
        return uuid4(f, ctx)
    if f.type == "integer":
        return int_column(f, ctx)
    if f.type == "float":
        return float_column(f, ctx)
    if f.type == "boolean":
        return bool_column(f, ctx)
    if f.type == "date":
        return date_column(f, ctx)
    if f.type == "datetime":
        return datetime_column(f, ctx)
    if "status" in name:
        return rng.pick(ctx.u(f.name), status_values(name))
    if "country" in name:
        return country(f, ctx)
    if "city" in name:
        return city(f, ctx)
    return word(f, ctx)
