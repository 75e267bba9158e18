"""Value generators: name -> Column of (row id, seed, key), by built-in functions only.

Each generator draws from its own key, so adding a column never changes another. Built within
``prf.bulk()``, texts of many draws take several from one hash and have no lambda, so that
whole-stage code generation covers them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import pools
from millrace.functions.prf import SPAN, draw, hex_digits, is_bulk, unit

Generator = Callable[[Column, int, str], Column]
#: The instant from which past and recent times are counted back, and future dates on.
EPOCH = "2026-01-01 00:00:00"
_DAY = 86_400


def _pick(values: Sequence[str], h: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (h % len(values) + 1).cast("int"))


def _from(name: str, values: Sequence[str]) -> Generator:
    return lambda i, seed, key: _pick(values, draw(seed, f"{key}.{name}", i))


first_name = _from("first", pools.FIRST_NAMES)
last_name = _from("last", pools.LAST_NAMES)
city = _from("city", pools.CITIES)
country = _from("country", pools.COUNTRIES)
country_code = _from("country_code", pools.COUNTRY_CODES)
currency_code = _from("currency", pools.CURRENCIES)


def integer(i: Column, seed: int, key: str, low: int = 1, high: int = 10_000) -> Column:
    """Inclusive at both ends; swapped bounds are put in order."""
    low, high = min(low, high), max(low, high)
    return F.lit(low) + draw(seed, key, i) % (high - low + 1)


def real(i: Column, seed: int, key: str, low: float = 0.0, high: float = 1000.0) -> Column:
    low, high = min(low, high), max(low, high)
    return F.lit(float(low)) + unit(draw(seed, key, i)) * F.lit(float(high - low))


def money(i: Column, seed: int, key: str, low: float = 0.01, high: float = 10_000.0) -> Column:
    return F.round(real(i, seed, key, low, high), 2)


def _fields(n: int, i: Column, seed: int, key: str) -> list[Column]:
    """``n`` uniform integers of 13 bits, four to a hash."""
    hashes = [draw(seed, key, i, k + 1) for k in range(-(-n // 4))]
    return [F.shiftrightunsigned(hashes[k // 4], 13 * (k % 4)).bitwiseAND(F.lit(8191)) for k in range(n)]


def _chars(alphabet: str, n: int, i: Column, seed: int, key: str) -> Column:
    if is_bulk():
        return F.concat(*[F.substring(F.lit(alphabet), (f % len(alphabet) + 1).cast("int"), F.lit(1)) for f in _fields(n, i, seed, key)])
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.substring(F.lit(alphabet), (draw(seed, key, i, k) % len(alphabet) + 1).cast("int"), F.lit(1))), "")


def _padded(low: int, high: int, width: int, i: Column, seed: int, key: str) -> Column:
    return F.lpad(integer(i, seed, key, low, high).cast("string"), width, "0")


def email(i: Column, seed: int, key: str) -> Column:
    return F.lower(F.concat(first_name(i, seed, key), F.lit("."), last_name(i, seed, key), F.lit("@"), _pick(pools.DOMAINS, draw(seed, f"{key}.domain", i))))


def full_name(i: Column, seed: int, key: str) -> Column:
    return F.concat_ws(" ", first_name(i, seed, key), last_name(i, seed, key))


def username(i: Column, seed: int, key: str) -> Column:
    return F.concat(F.lower(first_name(i, seed, key)), integer(i, seed, f"{key}.number", 10, 9999).cast("string"))


def phone(i: Column, seed: int, key: str) -> Column:
    part = partial(integer, i, seed)
    return F.concat(F.lit("+1-"), part(f"{key}.area", 200, 999).cast("string"), F.lit("-"), part(f"{key}.exchange", 200, 999).cast("string"), F.lit("-"), _padded(0, 9999, 4, i, seed, f"{key}.line"))


def word(i: Column, seed: int, key: str, attempt: Column | int = 0) -> Column:
    return _pick(pools.WORDS, draw(seed, f"{key}.word", i, attempt))


def url(i: Column, seed: int, key: str) -> Column:
    return F.concat(F.lit("https://"), word(i, seed, key), F.lit("."), _pick(pools.TLDS, draw(seed, f"{key}.tld", i)), F.lit("/"), _pick(pools.PATHS, draw(seed, f"{key}.path", i)))


def password(i: Column, seed: int, key: str) -> Column:
    return F.concat(F.lit("$2b$10$"), _chars(pools.BCRYPT, 53, i, seed, key))


def slug(i: Column, seed: int, key: str) -> Column:
    return F.concat_ws("-", *[word(i, seed, key, k) for k in range(3)])


def _sentence(i: Column, seed: int, key: str, nth: Column) -> Column:
    n = F.lit(5) + draw(seed, f"{key}.length", i, nth) % 8
    text = F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), lambda k: word(i, seed, key, nth * 100 + k)), " ")
    # Within a lambda each mention of an expression is worked out anew, so the text is bound to a name.
    capital = F.transform(F.array(text), lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)), F.lit(".")))
    return F.get(capital, F.lit(0))


def _bulk_sentence(i: Column, seed: int, key: str) -> Column:
    n, *picks = _fields(13, i, seed, f"{key}.words")
    own = [_pick(pools.WORDS, f) for f in picks]
    own = [w if k < 5 else F.when(n % 8 + 5 > k, w) for k, w in enumerate(own)]  # concat_ws leaves nulls out
    own[0] = F.initcap(own[0])
    return F.concat(F.concat_ws(" ", *own), F.lit("."))


def sentence(i: Column, seed: int, key: str) -> Column:
    """Five to twelve words, capitalised, with a full stop."""
    if is_bulk():
        return _bulk_sentence(i, seed, key)
    return _sentence(i, seed, key, F.lit(0))


def paragraph(i: Column, seed: int, key: str) -> Column:
    """Two to five sentences."""
    if is_bulk():
        n = draw(seed, f"{key}.sentences", i) % 4 + 2
        return F.concat_ws(" ", *[F.when(n > k, _bulk_sentence(i, seed, f"{key}.{k}")) for k in range(5)])
    n = F.lit(2) + draw(seed, f"{key}.sentences", i) % 4
    return F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), lambda k: _sentence(i, seed, key, k)), " ")


def company(i: Column, seed: int, key: str) -> Column:
    return F.concat_ws(" ", _pick(pools.COMPANY_BASES, draw(seed, f"{key}.base", i)), _pick(pools.COMPANY_KINDS, draw(seed, f"{key}.kind", i)))


def avatar_url(i: Column, seed: int, key: str) -> Column:
    return F.concat(F.lit("https://avatars.example.com/"), integer(i, seed, key, 1, 9999).cast("string"), F.lit(".png"))


def uuid4(i: Column, seed: int, key: str) -> Column:
    """Version 4: the version digit is 4, the variant digit one of 8, 9, a, b."""
    h = hex_digits(seed, key, i)
    variant = _pick("89ab", draw(seed, f"{key}.variant", i))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def token(i: Column, seed: int, key: str) -> Column:
    return hex_digits(seed, key, i)


def sku(i: Column, seed: int, key: str) -> Column:
    return F.concat(F.upper(_chars(pools.LETTERS, 3, i, seed, f"{key}.letters")), F.lit("-"), _padded(0, 99_999, 5, i, seed, f"{key}.digits"))


def latitude(i: Column, seed: int, key: str) -> Column:
    return F.round(real(i, seed, key, -90, 90), 6)


def longitude(i: Column, seed: int, key: str) -> Column:
    return F.round(real(i, seed, key, -180, 180), 6)


def postal_code(i: Column, seed: int, key: str) -> Column:
    return _padded(0, 99_999, 5, i, seed, key)


def street_address(i: Column, seed: int, key: str) -> Column:
    return F.concat_ws(" ", integer(i, seed, f"{key}.number", 1, 9999).cast("string"), _pick(pools.STREETS, draw(seed, f"{key}.street", i)), _pick(pools.STREET_KINDS, draw(seed, f"{key}.kind", i)))


def _shifted(seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds.cast("int"), F.lit(EPOCH).cast("timestamp_ntz"))


def datetime_past(i: Column, seed: int, key: str) -> Column:
    """Up to two years before EPOCH, to the second."""
    return _shifted(-integer(i, seed, key, 0, 2 * 365 * _DAY))


def datetime_recent(i: Column, seed: int, key: str) -> Column:
    return _shifted(-integer(i, seed, key, 0, 7 * _DAY))


def date_future(i: Column, seed: int, key: str) -> Column:
    return F.date_add(F.lit(EPOCH[:10]).cast("date"), integer(i, seed, key, 0, 364).cast("int"))


def ipv4(i: Column, seed: int, key: str) -> Column:
    ends = (1, 254), (0, 255), (0, 255), (1, 254)
    return F.concat_ws(".", *[integer(i, seed, f"{key}.{k}", low, high).cast("string") for k, (low, high) in enumerate(ends)])


def boolean(i: Column, seed: int, key: str, true_rate: float = 0.5) -> Column:
    return unit(draw(seed, key, i)) < F.lit(true_rate)


def enum_pick(i: Column, seed: int, key: str, labels: Sequence[str] = ()) -> Column:
    """One label, each as likely; null without labels."""
    return _pick(labels, draw(seed, key, i)) if labels else F.lit(None).cast("string")


def json_empty(i: Column, seed: int, key: str) -> Column:
    return F.lit("{}")


def hex_color(i: Column, seed: int, key: str) -> Column:
    return F.concat(F.lit("#"), F.upper(F.substring(hex_digits(seed, key, i), 1, 6)))


def random_string(i: Column, seed: int, key: str, max_length: int = 255) -> Column:
    """Exactly min(max_length, 16) letters and digits."""
    n = min(max_length, 16)
    return _chars(pools.ALPHANUMERIC, n, i, seed, key) if n > 0 else F.lit("")


def null(i: Column, seed: int, key: str) -> Column:
    return F.lit(None).cast("string")


def serial(i: Column, seed: int, key: str) -> Column:
    return i + 1


def weighted(i: Column, seed: int, key: str, weights: Mapping[str, float] | None = None, kind: str = "string") -> Column:
    """A key of ``weights`` in proportion to its weight, keys in order; cast to ``kind``.

    Weights need not sum to 100; negative ones count 0; without any weight the result is null.
    """
    rest = sorted((k, max(0.0, w)) for k, w in (weights or {}).items())
    total = sum(w for _, w in rest)
    if total <= 0:
        return F.lit(None).cast(kind)
    rest = [(k, w) for k, w in rest if w > 0]
    at, out, upto = unit(draw(seed, key, i)) * F.lit(float(total)), None, 0.0
    for value, weight in rest[:-1]:
        upto += weight
        out = (F.when if out is None else out.when)(at < F.lit(upto), F.lit(value))
    last = F.lit(rest[-1][0])
    return (last if out is None else out.otherwise(last)).cast(kind)


def ranged(i: Column, seed: int, key: str, low: float, high: float, kind: str = "double") -> Column:
    """A range override by column type: whole numbers inclusive, dates and times within, else a double below ``high``."""
    if kind in ("short", "int", "long", "smallint", "integer", "bigint"):
        return integer(i, seed, key, round(low), round(high)).cast(kind)
    if kind in ("date", "timestamp", "timestamp_ntz"):  # bounds are days since 1970-01-01
        seconds = integer(i, seed, key, int(low * _DAY), int(high * _DAY))
        at = F.timestamp_seconds(seconds).cast("timestamp_ntz")
        return at.cast(kind)
    return real(i, seed, key, low, high).cast(kind)


def picked(x: Column, counts: Sequence[int]) -> Column:
    """The index, from 0, of the count in whose part of their running sum a whole number x, modulo the sum, lies."""
    ends, at = [], 0
    for n in counts:
        at += n
        ends.append(at)
    r = F.pmod(x, F.lit(max(at, 1)))
    return F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends[:-1]] or [F.lit(1 << 62)]), lambda e: e <= r)).cast("long")


def inverse(u: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The value at rank u in [0, 1) of a distribution by its quantiles (share, value), linear between them."""
    out = None
    for (q, v), (r, w) in zip(knots, knots[1:], strict=False):
        own = F.lit(float(v)) + (u - F.lit(float(q))) * F.lit((w - v) / (r - q))
        out = (F.when if out is None else out.when)(u < F.lit(float(r)), own)
    return F.lit(float(knots[0][1])) if out is None else out.otherwise(F.lit(float(knots[-1][1])))


def shaped(u: Column, knots: Sequence[tuple[float, float]], kind: str = "double") -> Column:
    """``inverse`` as a column's type; whole numbers are the nearest."""
    value = inverse(u, knots)
    return F.floor(value + 0.5).cast(kind) if kind in ("tinyint", "smallint", "int", "bigint") else value.cast(kind)


def joint_ranks(i: Column, seed: int, key: str, counts: Sequence[Sequence[Sequence[int]]]) -> list[Column]:
    """Ranks in [0, 1) of columns that hang together: a chain of empirical copulas.

    ``counts[k][a][b]`` is how many rows have column k in bin a and column k + 1 in bin b. The first column's bin is drawn
    by its rows, each further one's by those that share the bin before it; inside a bin ranks are even.
    """
    bins = len(counts[0])
    at = picked(draw(seed, f"{key}.bin0", i), [sum(row) for row in counts[0]])
    out = [at]
    for k, table in enumerate(counts, 1):
        x = draw(seed, f"{key}.bin{k}", i)
        choice = F.when(at == 0, picked(x, table[0]))
        for a in range(1, bins):
            choice = choice.when(at == a, picked(x, table[a]))
        at = choice
        out.append(at)
    return [(b + unit(draw(seed, f"{key}.rank{k}", i))) / F.lit(float(bins)) for k, b in enumerate(out)]


def dated(i: Column, seed: int, key: str, months: Mapping[str, int], hours: Mapping[str, float], weekday_ratio: float | None, low: str, high: str) -> Column:
    """A time by densities: month by its rows, a day of it, moved by as little as makes the share of weekdays, hour by its share.

    The result lies in low..high. Shares of hours count in millionths.
    """
    names = sorted(months)
    month = F.add_months(F.lit(f"{names[0]}-01").cast("date"), F.get(F.array(*[F.lit(12 * (int(m[:4]) - int(names[0][:4])) + int(m[5:]) - int(names[0][5:])) for m in names]), picked(draw(seed, f"{key}.month", i), [months[m] for m in names]).cast("int")))
    last = F.last_day(month)
    day = F.date_add(month, F.pmod(draw(seed, f"{key}.day", i), F.dayofmonth(last)).cast("int"))
    if weekday_ratio is not None:
        week = F.weekday(day)
        back = F.when((week == 5) & (day == month), 2).when(week == 5, -1).when((week == 6) & (day == last), -2).when(week == 6, 1).otherwise(0)
        coin = F.pmod(draw(seed, f"{key}.end", i), F.lit(2)).cast("int")
        ahead = F.date_add(day, 5 - week)
        away = F.when(week >= 5, 0).when(F.date_add(ahead, coin) <= last, 5 - week + coin).when(ahead <= last, 5 - week).otherwise(-(week + 1))
        day = F.date_add(day, F.when(unit(draw(seed, f"{key}.week", i)) * 100 < F.lit(float(weekday_ratio)), back).otherwise(away))
    shares = [round(hours.get(str(h), 0.0) * 1_000_000) for h in range(24)]
    hour = picked(draw(seed, f"{key}.hour", i), shares) if sum(shares) else F.lit(0)
    second = F.pmod(draw(seed, f"{key}.second", i), F.lit(3600))
    at = F.timestamp_add("SECOND", (hour * 3600 + second).cast("int"), day.cast("timestamp_ntz"))
    return F.least(F.greatest(at, F.lit(low).cast("timestamp_ntz")), F.lit(high).cast("timestamp_ntz"))


def with_nulls(value: Column, i: Column, seed: int, key: str, null_rate: float) -> Column:
    """Null for ``null_rate`` percent of the rows."""
    return F.when(unit(draw(seed, f"{key}.null", i)) * 100 >= null_rate, value)


def unique_text(value: Column, i: Column) -> Column:
    """Distinct by construction: the row id in base 36, before the @ of an address or at the end."""
    tail = F.concat(F.lit("-"), F.lower(F.conv(i.cast("string"), 10, 36)))
    at = F.instr(value, "@")
    return F.when(at > 0, F.concat(F.substring(value, F.lit(1), at - 1), tail, F.substring(value, at, F.length(value)))).otherwise(F.concat(value, tail))


def unique_integer(i: Column, seed: int, low: int, high: int) -> Column:
    """Distinct whole numbers of a range: an affine bijection of row ids modulo its size. Ids at or over the size give null."""
    size, step = high - low + 1, 2 * (SPAN // 5) + 1
    from math import gcd

    while gcd(step, size) != 1:
        step += 2
    return F.when(i < size, F.lit(low) + (i * F.lit(step % size) + F.lit(seed % size)) % F.lit(size))


GENERATORS: dict[str, Generator] = {
    "email": email, "first_name": first_name, "last_name": last_name, "full_name": full_name, "username": username, "phone": phone, "url": url,
    "password": password, "slug": slug, "sentence": sentence, "paragraph": paragraph, "company": company, "avatar_url": avatar_url, "uuid": uuid4,
    "token": token, "sku": sku, "money": money, "random_int": integer, "random_float": real, "latitude": latitude, "longitude": longitude,
    "city": city, "country": country, "country_code": country_code, "postal_code": postal_code, "street_address": street_address,
    "datetime_past": datetime_past, "datetime_recent": datetime_recent, "date_future": date_future, "ipv4": ipv4, "bool": boolean,
    "enum_pick": enum_pick, "json_empty": json_empty, "hex_color": hex_color, "currency_code": currency_code, "random_string": random_string,
    "null": null, "serial": serial,
}
