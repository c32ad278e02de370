"""Generated requests of an invented interface, whose routes are known beforehand.

A ``Spec`` describes resources with operations, path variables, parameters, body fields, headers and cookies.  ``requests`` turns it into
rows by hashes of (seed, seq), so the same spec gives the same rows in any number of partitions; ``expected`` tells what a tree built from
enough of them has to hold.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A path variable's value from a whole number, and what the variable is called after its parent.
ID_KINDS: dict[str, tuple[Callable[[Column], Column], str]] = {
    "integer": (lambda x: (x + 100_000).cast("string"), "id"),
    "uuid": (lambda x: F.regexp_replace(F.md5(x.cast("string")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), "uuid"),
    "phone": (lambda x: F.concat(F.lit("138"), F.lpad(x.cast("string"), 8, "0")), "phone"),
    "version": (lambda x: F.concat(F.lit("v"), (x % 9 + 1).cast("string")), "version"),
    "code": (lambda x: F.concat(F.lit("item"), (x + 100).cast("string")), "code"),
}
OPERATIONS = {"list": ("GET", False), "get": ("GET", True), "create": ("POST", False), "update": ("PUT", True), "delete": ("DELETE", True)}


@dataclass(frozen=True)
class Param:
    """values: what the parameter takes in turn; presence: the share of requests that have it."""

    name: str
    values: tuple[str, ...]
    presence: float = 1.0


@dataclass(frozen=True)
class Resource:
    name: str
    prefix: tuple[str, ...] = ("api",)
    id_kind: str = "integer"
    operations: tuple[str, ...] = ("list", "get", "create", "update", "delete")
    query: tuple[Param, ...] = ()
    fields: tuple[Param, ...] = ()
    json: bool = True
    headers: tuple[Param, ...] = ()
    cookies: tuple[Param, ...] = ()


@dataclass(frozen=True)
class Spec:
    seed: int = 0
    resources: tuple[Resource, ...] = field(default_factory=tuple)

    def __str__(self) -> str:
        lines = [f"seed {self.seed}, {len(self.resources)} resources"]
        lines += [f"  /{'/'.join([*r.prefix, r.name])} by {r.id_kind}: {', '.join(r.operations)}" for r in self.resources]
        return "\n".join(lines)


def random_spec(seed: int, n_resources: int = 4) -> Spec:
    """An invented interface; the same seed gives the same one."""
    rng = random.Random(seed)
    names = ["users", "orders", "products", "invoices", "teams", "tickets", "photos", "devices", "reports", "carts", "coupons", "events"]
    made = []
    for i, name in enumerate(rng.sample(names, min(n_resources, len(names)))):
        query = tuple(Param(n, v, rng.choice((1.0, 1.0, 0.5))) for n, v in rng.sample([("page", ("1", "2", "3")), ("size", ("10", "20", "50")), ("sort", ("asc", "desc")), ("q", ("red", "blue"))], 2))
        fields = tuple(Param(n, v) for n, v in rng.sample([("name", ("ann", "bob", "eve")), ("age", ("21", "34")), ("email", ("a@example.org", "b@example.org")), ("active", ("true", "false"))], 2))
        made.append(Resource(f"{name}{i // len(names) or ''}", ("api", rng.choice(("v1", "v2"))), rng.choice(tuple(ID_KINDS)), query=query, fields=fields, json=rng.random() < 0.7,
                             headers=(Param("Accept", ("application/json", "text/html;q=0.9")), Param("Authorization", ("Bearer t", "Basic u"))), cookies=(Param("lang", ("en", "zh")),)))
    return Spec(seed, tuple(made))


def _drawn(spec: Spec, *salt) -> Column:
    """A whole number from 0 that depends on the row, the seed and the salt."""
    return F.xxhash64(F.lit(spec.seed), *[F.lit(s) for s in salt], "seq").bitwiseAND(F.lit((1 << 31) - 1).cast("long"))


def _value(spec: Spec, p: Param, *salt) -> Column:
    """The parameter's value, null where the row doesn't have it."""
    value = F.element_at(F.array(*[F.lit(v) for v in p.values]), (_drawn(spec, *salt, p.name, "v") % len(p.values) + 1).cast("int"))
    return value if p.presence >= 1 else F.when(_drawn(spec, *salt, p.name, "p") % 1000 < int(1000 * p.presence), value)


def requests(spark: SparkSession, spec: Spec, n: int, ids: int = 100_000) -> DataFrame:
    """n rows of requests (seq and the columns that parse() takes); ``ids``: different values of each path variable at most."""
    null = F.lit(None).cast("string")
    rows = spark.range(n).withColumnRenamed("id", "seq")
    if not spec.resources:
        return rows.where("false").select("seq", *[null.alias(c) for c in ("method", "url", "content_type", "body", "accept", "authorization", "cookie")])
    which = _drawn(spec, "resource") % len(spec.resources)
    choose = lambda parts: F.coalesce(*[F.when(which == i, p) for i, p in enumerate(parts)], null)
    methods, urls, types, bodies, accepts, auths, cookies = [], [], [], [], [], [], []
    for i, r in enumerate(spec.resources):
        op = _drawn(spec, i, "op") % len(r.operations)
        is_ = lambda name, r=r, op=op: (op == r.operations.index(name)) if name in r.operations else F.lit(False)
        methods.append(F.coalesce(*[F.when(is_(o), OPERATIONS[o][0]) for o in r.operations]))
        base = "/" + "/".join([*r.prefix, r.name])
        single = F.concat(F.lit(f"{base}/"), ID_KINDS[r.id_kind][0](_drawn(spec, i, "id") % ids))
        pairs = F.array_compact(F.array(*[F.concat(F.lit(f"{p.name}="), _value(spec, p, i)) for p in r.query])) if r.query else F.array().cast("array<string>")
        urls.append(F.when(is_("list"), F.concat(F.lit(base), F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(""))).when(is_("create"), F.lit(base)).otherwise(single))
        has_body = is_("create") | is_("update")
        types.append(F.when(has_body, "application/json" if r.json else "application/x-www-form-urlencoded"))
        if r.json:
            body = F.to_json(F.struct(*[_value(spec, p, i).alias(p.name) for p in r.fields])) if r.fields else F.lit("{}")
        else:
            body = F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f"{p.name}="), _value(spec, p, i)) for p in r.fields])), "&") if r.fields else F.lit("")
        bodies.append(F.when(has_body, body))
        named = {p.name: _value(spec, p, i) for p in r.headers}
        accepts.append(named.get("Accept", null))
        auths.append(named.get("Authorization", null))
        cookies.append(F.array_join(F.array(*[F.concat(F.lit(f"{p.name}="), _value(spec, p, i)) for p in r.cookies]), "; ") if r.cookies else null)
    columns = {"method": methods, "url": urls, "content_type": types, "body": bodies, "accept": accepts, "authorization": auths, "cookie": cookies}
    return rows.select("seq", *[choose(v).alias(k) for k, v in columns.items()])


def expected(spec: Spec) -> list[dict]:
    """What a tree of enough rows holds: a dict (route, method, variable, required) for each operation."""
    out = []
    for r in spec.resources:
        base = "/" + "/".join([*r.prefix, r.name])
        variable = f"{r.name}_{ID_KINDS[r.id_kind][1]}"
        for o in r.operations:
            method, single = OPERATIONS[o]
            needed = [p.name for p in (r.query if o == "list" else r.fields if o in ("create", "update") else ()) if p.presence >= 1]
            out.append({"route": f"{base}/{{{variable}}}" if single else base, "method": method, "variable": variable if single else None, "required": sorted(needed)})
    return out
