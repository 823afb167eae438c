"""Column functions: keys, hashes, rates, analytic rates of membership screens, row checks.

Everything here is built from Spark's own functions, so it stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multipliers of the scope rule and the label and result names.
GENERATION_PRIME = 15485863
VERSION_PRIME = 32452843
RESULT_OF_LABEL = {"VALID": "MATCH", "NO_ACCOUNT": "NO_ACCOUNT", "INVALID_DISTINCT": "CREDENTIAL_MISMATCH", "INVALID_REPEATED": "CREDENTIAL_MISMATCH"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tuple_key(*cols) -> Column:
    """Identity of an attempt's tuple as one struct, for grouping and joins."""
    return F.struct(*map(_c, cols or ("account", "generation", "version", "token")))


def scope_key(*cols) -> Column:
    return F.struct(*map(_c, cols or ("account", "generation", "version")))


def label_to_result(label) -> Column:
    out = F.lit(None).cast("string")
    for name, result in RESULT_OF_LABEL.items():
        out = F.when(_c(label) == name, result).otherwise(out)
    return out


def is_existing_invalid(label) -> Column:
    return _c(label).isin("INVALID_DISTINCT", "INVALID_REPEATED")


def scope_at(index, account, churn_period: int, rotation_period: int) -> dict[str, Column]:
    """Generation, version, age fraction and recent-rotation flag of an account at an event index."""
    index, account = _c(index), _c(account)
    spun = index + account * F.lit(VERSION_PRIME)
    age = (spun % rotation_period) / float(rotation_period)
    return {
        "generation": F.lit(1) + F.floor((index + account * F.lit(GENERATION_PRIME)) / churn_period).cast("long"),
        "version": F.lit(1) + F.floor(spun / rotation_period).cast("long"),
        "age_fraction": age,
        "rotation_recent": age < 0.05,
    }


def encode_fields(*cols) -> Column:
    """Fields, each after its length in eight digits: no two rows of fields look alike."""
    parts = []
    for c in cols:
        text = _c(c).cast("string")
        parts += [F.lpad(F.length(text).cast("string"), 8, "0"), text]
    return F.concat(*parts)


def stable_token(key: str, *cols, bits: int = 128) -> Column:
    """Keyed token of the encoded fields in hexadecimal."""
    return F.substring(F.sha2(F.concat(F.lit(f"{key}|"), encode_fields(*cols)), 256), 1, bits // 4)


def hash32(col, at: int = 0) -> Column:
    """Unsigned 32 bits of the MD5 of a text, from hexadecimal digit 8 * ``at``."""
    return F.conv(F.substring(F.md5(_c(col).cast("string").cast("binary")), 1 + 8 * at, 8), 16, 10).cast("long")


def hash_unit(col, seed: int | str = "") -> Column:
    """A hash in [0, 1)."""
    text = F.concat(F.lit(f"{seed}|"), _c(col).cast("string"))
    return hash32(text) / float(1 << 32)


def hash_region(n: int, *cols) -> Column:
    """Stable region of an encoded key."""
    return hash32(encode_fields(*cols)) % n


def sticky_sample(col, seed, start: int, stop: int, epsilon: float) -> Column:
    """Whether an identity is kept: the same answer each time it is asked."""
    return hash_unit(col, f"{seed}:{start}:{stop}") < epsilon


def token_prefix(token, bits: int) -> Column:
    """The leading bits of a hexadecimal token: up to 60 as a number, more as hexadecimal digits whose last one
    has its unused low bits cleared."""
    digits = -(-bits // 4)
    if bits > 60:
        last = F.conv(F.substring(_c(token), digits, 1), 16, 10).cast("int").bitwiseAND(F.lit(16 - (1 << (4 * digits - bits))))
        return F.lower(F.concat(F.substring(_c(token), 1, digits - 1), F.hex(last)))
    return F.shiftright(F.conv(F.substring(_c(token), 1, digits), 16, 10).cast("long"), 4 * digits - bits)


def probe_positions(token, k: int, m: int) -> Column:
    """k double-hash positions in m bits."""
    first, step = hash32(token, 0), hash32(token, 1).bitwiseOR(F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (first + i * step) % m)


def blocked_positions(token, k: int, blocks: int) -> Column:
    """k positions inside one block of 512 bits; an odd step visits a block's bits without repeat."""
    base = (hash32(token, 0) % blocks) * 512
    first, step = hash32(token, 1).bitwiseAND(F.lit(511)), hash32(token, 2).bitwiseOR(F.lit(1)).bitwiseAND(F.lit(511))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: base + (first + i * step).bitwiseAND(F.lit(511)))


def bloom_fpr_finite(m, n, k) -> Column:
    """False-positive rate of n items on m bits, k independent places each."""
    m, n, k = (_c(x).cast("double") for x in (m, n, k))
    return F.when(n == 0, 0.0).when(m == 1, 1.0).otherwise(F.pow(1.0 - F.exp(k * n * F.log1p(-1.0 / m)), k))


def bloom_fpr_standard(m, n, k) -> Column:
    m, n, k = (_c(x).cast("double") for x in (m, n, k))
    return F.pow(-F.expm1(-k * n / m), k)


def blocked_bloom_fpr(blocks, block_bits, n, k) -> Column:
    """Mean finite rate over the binomial load of one block, within twelve deviations.

    Masses follow from the ratio of neighbours, so no factorial is needed; they are taken relative
    to the mass at the mean and normalised at the end.
    """
    b, bits, n, k = (_c(x).cast("double") for x in (blocks, block_bits, n, k))
    p = 1.0 / b
    mean, sigma = n * p, F.sqrt(n * p * (1.0 - p))
    low = F.greatest(F.lit(0.0), F.floor(mean - 12.0 * sigma - 8.0).cast("double"))
    high = F.least(n, F.ceil(mean + 12.0 * sigma + 8.0).cast("double"))
    peak = F.floor(mean).cast("double")
    odds = p / (1.0 - p)
    rate = lambda x: F.when(x == 0, 0.0).otherwise(F.pow(1.0 - F.exp(k * x * F.log1p(-1.0 / bits)), k))
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("mass"), F.lit(0.0).alias("total"))

    def up(s, x):  # from the peak upwards: s.w is the mass at x
        return F.struct((s["w"] * (n - x) / (x + 1.0) * odds).alias("w"), (s["mass"] + s["w"]).alias("mass"), (s["total"] + s["w"] * rate(x)).alias("total"))

    def down(s, x):  # below the peak: s.w is the mass at x + 1
        w = s["w"] * (x + 1.0) / (n - x) / odds
        return F.struct(w.alias("w"), (s["mass"] + w).alias("mass"), (s["total"] + w * rate(x)).alias("total"))

    doubles = lambda a, z, step: F.transform(F.sequence(a.cast("long"), z.cast("long"), F.lit(step).cast("long")), lambda v: v.cast("double"))
    above = F.aggregate(doubles(peak, high, 1), start, up)
    below = F.when(peak > low, F.aggregate(doubles(F.greatest(peak - 1.0, low), low, -1), start, down)).otherwise(start)
    mixed = (above["total"] + below["total"]) / (above["mass"] + below["mass"])
    return F.when(n == 0, 0.0).when(b == 1, rate(n)).otherwise(mixed)


def fingerprint_fpr(load, bits, slots) -> Column:
    """Two buckets of ``slots`` fingerprints, of which the share ``load`` is occupied."""
    per_slot = _c(load) / (F.pow(F.lit(2.0), _c(bits)) - 1.0)
    return -F.expm1(2.0 * _c(slots) * F.log1p(-per_slot))


def expected_probes(p, k) -> Column:
    """Probes until the first zero bit when each is set with probability p."""
    p, k = _c(p).cast("double"), _c(k).cast("double")
    return F.when(p == 1.0, k).otherwise((1.0 - F.pow(p, k)) / (1.0 - p))


def expected_probes_without_replacement(set_bits, total_bits, k: int) -> Column:
    """The same when the k places of a probe differ."""
    s, t = _c(set_bits).cast("double"), _c(total_bits).cast("double")
    start = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"))

    def step(acc, i):
        p = acc["p"] * F.greatest(F.lit(0.0), s - (i - 1)) / (t - (i - 1))
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"))

    places = F.when(F.lit(k) > 1, F.sequence(F.lit(1), F.lit(max(1, k - 1)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step)["sum"]


def expected_probes_layers(p_array, k_array) -> Column:
    """Layers asked one after the other, each reached only through the ones before."""
    start = F.struct(F.lit(1.0).alias("reach"), F.lit(0.0).alias("sum"))

    def step(acc, x):
        return F.struct((acc["reach"] * F.pow(x["p"], x["k"].cast("double"))).alias("reach"), (acc["sum"] + acc["reach"] * expected_probes(x["p"], x["k"])).alias("sum"))

    return F.aggregate(F.arrays_zip(_c(p_array).alias("p"), _c(k_array).alias("k")), start, step)["sum"]


def memory_bytes(entries, entry_bytes: int, alignment: int, load_factor: float, fixed: int) -> Column:
    """Bytes of a table: aligned entries, room for the load factor, a fixed part."""
    aligned = -(-entry_bytes // alignment) * alignment
    return F.ceil(_c(entries) / load_factor) * aligned + fixed


def slot_bytes(entry_bytes: int, alignment: int, load_num: int, load_den: int, overhead: int) -> int:
    """Bytes of one slot of a cache's table: the aligned entry, its share of empty slots, the allocator's part."""
    aligned = -(-entry_bytes // alignment) * alignment
    return -(-aligned * load_den // load_num) + overhead


def cache_memory(capacity, policy, slot: int, per_policy: dict[str, int], fixed: int) -> dict[str, Column]:
    """Bytes of a cache by part and in total.

    No cache (null policy) takes none.  A policy outside ``per_policy`` has no packed layout: its own bytes and
    the total are null, and ``accounted`` is false.
    """
    n, p = _c(capacity).cast("long"), _c(policy)
    none, known = p.isNull(), p.isin(list(per_policy))
    each = F.element_at(F.create_map(*[F.lit(x) for kv in per_policy.items() for x in kv]), p)
    parts = {"entry_bytes": n * slot, "policy_bytes": n * F.when(known, each), "fixed_bytes": F.lit(fixed)}
    out = {k: F.when(none, F.lit(0)).otherwise(v).cast("long") for k, v in parts.items()}
    total = out["entry_bytes"] + out["policy_bytes"] + out["fixed_bytes"]
    return out | {"total_bytes": total, "accounted": none | known}


def timing_features(timings: list, sizes) -> dict[str, Column]:
    """Log timings and the shape of an array of sizes."""
    s = _c(sizes)
    out = {f"log_{c}": F.log1p(F.col(c)) for c in timings}
    weighted = F.aggregate(F.transform(s, lambda x, i: (i + 1) * x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return out | {
        "n_sizes": F.size(s).cast("long"), "first_size": F.element_at(s, 1), "last_size": F.element_at(s, -1),
        "min_size": F.array_min(s), "max_size": F.array_max(s), "weighted_sizes": weighted,
    }


def semantic_id(*cols) -> Column:
    """Hash of the row's meaning: the named columns, in the order of their names, as JSON."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])), 256)


def exact_ratio(num, den, digits: int = 9) -> Column:
    """num / den as a decimal rounded half to even; null where den is 0."""
    d = F.nullif(_c(den).cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)"))
    return F.bround(_c(num).cast("decimal(18,0)") / d, digits).cast(f"decimal(38,{digits})")


def at_most_ratio(a, b, num: int, den: int) -> Column:
    """a / b <= num / den in whole numbers."""
    return _c(a) * den <= _c(b) * num


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks; a rule is the condition of a good row, null counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def is_exact_mismatch(expected_version, checked_version, expected_ids, checked_ids, kind, status="status", stale=None) -> Column:
    """Whether a backend answer proves a mismatch for the expected credentials: it may be learned."""
    return F.coalesce(
        (_c(kind) == "CREDENTIAL_MISMATCH")
        & (_c(status) == "PRESENT")
        & _c(expected_version).isNotNull()
        & (_c(expected_version) == _c(checked_version))
        & (F.size(_c(expected_ids)) > 0)
        & (F.array_sort(_c(expected_ids)) == F.array_sort(_c(checked_ids)))
        & (~stale if stale is not None else F.lit(True)),
        F.lit(False),
    )
