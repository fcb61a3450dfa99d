"""Format-preserving pseudonyms for personal numbers, dates and addresses, by DataFrame functions only.

A found value is checked (card numbers by their check digit, network addresses by their range, social security numbers
by their assigned ranges, dates by the calendar), then permuted by a keyed Feistel network inside its own format:
letters stay letters, digits stay digits, separators stay, a card keeps a right check digit, a date stays a date. Equal
values get equal pseudonyms in every document; whoever holds the key can undo them (``inverse=True``).

Two networks: strings of letters and digits (halves shifted character by character by a keyed hash of the other half),
and pairs (a, b) of whole numbers in Z_A x Z_B. The 146,097 days of a 400-year cycle are Z_189 x Z_773. Of a date with
slashes the month is read first; where that is no date, the day is, and such dates (day above 12) stay among themselves:
88,497 in a cycle, Z_9 x Z_9833.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import let, text_of

ROUNDS = 8
#: At most 64 characters of a name (no mail server takes more) and no repeated group: time stays linear in the text.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9-])(?:1[3-9]|2[0-8])[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9./])[0-9]{2}([./])[0-9]{2}\1(?:1[3-9]|2[0-8])[0-9]{2}(?![0-9/])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9+])(?:\+?1[\x20.-]?)?(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[\x20.-])[2-9][0-9]{2}[\x20.-][0-9]{4}(?![0-9])"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])"
#: Order of trial at one place of a text.
KINDS = {"email": EMAIL, "ssn": SSN, "phone": PHONE, "card": CARD, "ip": IP, "date": DATE}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
_A, _B, _CYCLE = 189, 773, 189 * 773
_LATE_A, _LATE_B, _LATE = 9, 9833, 9 * 9833


def _hash_number(*parts: Column | str) -> Column:
    digest = F.sha2(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _rounds(inverse: bool) -> Column:
    order = range(ROUNDS, 0, -1) if inverse else range(1, ROUNDS + 1)
    return F.array(*[F.lit(i) for i in order])


def permute_pair(a: Column, b: Column, size_a: int, size_b: int, key: str, kind: str, inverse: bool = False) -> Column:
    """Keyed permutation of Z_A x Z_B as a struct (a, b)."""
    sign = -1 if inverse else 1

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        new_a = F.pmod(s["a"] + sign * (_hash_number(key, kind, i.cast("string"), s["b"].cast("string")) % size_a), F.lit(size_a))
        new_b = F.pmod(s["b"] + sign * (_hash_number(key, kind, i.cast("string"), s["a"].cast("string")) % size_b), F.lit(size_b))
        return F.struct(
            F.when(odd, new_a).otherwise(s["a"]).cast("long").alias("a"),
            F.when(odd, s["b"]).otherwise(new_b).cast("long").alias("b"),
        )

    return F.aggregate(_rounds(inverse), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def _shift(s: Column, stream: Column, sign: int) -> Column:
    """Every letter and digit moved inside its own class by the key stream (hexadecimal)."""

    def one(j: Column) -> Column:
        c = F.ascii(F.substr(s, j, F.lit(1)))
        k = sign * F.conv(F.substr(stream, 2 * ((j - 1) % 64) + 1, F.lit(2)), 16, 10).cast("int")
        moved = (
            F.when(c.between(48, 57), 48 + F.pmod(c - 48 + k, F.lit(10)))
            .when(c.between(65, 90), 65 + F.pmod(c - 65 + k, F.lit(26)))
            .when(c.between(97, 122), 97 + F.pmod(c - 97 + k, F.lit(26)))
            .otherwise(c)
        )
        return F.char(moved)

    return F.when(F.length(s) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), one), ""))


def permute_string(s: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """Keyed permutation of ASCII strings that keeps the class of every character."""
    n = F.length(s)
    half = F.floor((n + 1) / 2).cast("int")
    sign = -1 if inverse else 1

    def turn(x: Column, i: Column) -> Column:
        odd = i % 2 == 1

        def stream(other: Column) -> Column:
            return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), n.cast("string"), i.cast("string"), other), 512)

        return F.struct(
            F.when(odd, let(stream(x["r"]), lambda k: _shift(x["l"], k, sign))).otherwise(x["l"]).alias("l"),
            F.when(odd, x["r"]).otherwise(let(stream(x["l"]), lambda k: _shift(x["r"], k, sign))).alias("r"),
        )

    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, n).alias("r"))
    return F.aggregate(_rounds(inverse), start, turn, lambda x: F.concat(x["l"], x["r"]))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced one by one."""
    place = lambda i: F.length(_digits(F.substr(shape, F.lit(1), i)))
    return F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.length(shape)),
            lambda i: F.when(F.ascii(F.substr(shape, i, F.lit(1))).between(48, 57), F.substr(digits, place(i), F.lit(1))).otherwise(
                F.substr(shape, i, F.lit(1))
            ),
        ),
        "",
    )


def luhn_sum(digits: Column, first_doubled: int) -> Column:
    """Sum of the check-digit rule; ``first_doubled`` is 0 when the last digit is doubled, 1 when the one before it is."""
    n = F.length(digits)
    table = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == first_doubled, F.get(table, d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _card(hit: Column, key: str, inverse: bool) -> Column:
    """The first digit (the kind of card) stays; the check digit is computed anew."""

    def checked(body: Column) -> Column:
        return F.concat(body, F.pmod(10 - luhn_sum(body, 0) % 10, F.lit(10)).cast("string"))

    def moved(d: Column) -> Column:
        middle = let(F.substr(d, F.lit(2), F.length(d) - 2), lambda m: permute_string(m, key, "card", inverse))
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), middle)
        return F.when(luhn_sum(d, 1) % 10 == 0, let(let(body, checked), lambda new: _refill(hit, new)))

    return let(_digits(hit), moved)


def _phone(hit: Column, key: str, inverse: bool) -> Column:
    """The country code and the first digits of area and exchange stay (their values are restricted)."""

    def moved(d: Column) -> Column:
        ten = F.substr(d, F.length(d) - 9, F.lit(10))
        free = F.concat(F.substr(ten, F.lit(2), F.lit(2)), F.substr(ten, F.lit(5), F.lit(6)))

        def filled(new: Column) -> Column:
            return F.concat(
                F.substr(d, F.lit(1), F.length(d) - 10), F.substr(ten, F.lit(1), F.lit(1)), F.substr(new, F.lit(1), F.lit(2)),
                F.substr(ten, F.lit(4), F.lit(1)), F.substr(new, F.lit(3), F.lit(6)),
            )

        new = let(free, lambda f: permute_string(f, key, "phone", inverse))
        return let(let(new, filled), lambda digits: _refill(hit, digits))

    return let(_digits(hit), moved)


def _ssn(hit: Column, key: str, inverse: bool) -> Column:
    d = _digits(hit)
    area, group, serial = (F.substr(d, F.lit(i), F.lit(n)).cast("int") for i, n in ((1, 3), (4, 2), (6, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = F.when(area > 666, area - 2).otherwise(area - 1)

    def written(p: Column) -> Column:
        new = F.floor(p["a"] / 99)
        return F.format_string("%03d-%02d-%04d", F.when(new >= 665, new + 2).otherwise(new + 1), p["a"] % 99 + 1, p["b"] + 1)

    return F.when(valid, let(permute_pair(rank * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn", inverse), written))


def _ip(hit: Column, key: str, inverse: bool) -> Column:

    def written(p: Column) -> Column:
        numbers = (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)
        return F.concat_ws(".", *[x.cast("long").cast("string") for x in numbers])

    def moved(o: Column) -> Column:
        high, low = (F.get(o, F.lit(i)) * 256 + F.get(o, F.lit(i + 1)) for i in (0, 2))
        new = let(permute_pair(high, low, 65536, 65536, key, "ip", inverse), written)
        return F.when(F.forall(o, lambda x: x <= 255) & ~F.rlike(hit, F.lit(r"(^|\.)0[0-9]")), new)

    return let(F.transform(F.split(hit, r"\."), lambda x: x.cast("int")), moved)


def _date(hit: Column, form: str, key: str, inverse: bool) -> Column:
    first = F.lit("1700-01-01").cast("date")

    def moved(n: Column) -> Column:
        cycle = F.floor(n / _CYCLE).cast("int")
        inside = n - cycle * _CYCLE
        pair = permute_pair(F.floor(inside / _B), inside % _B, _A, _B, key, "date", inverse)
        day = let(pair, lambda p: F.date_add(first, (cycle * _CYCLE + p["a"] * _B + p["b"]).cast("int")))
        return F.when(n.isNotNull(), F.date_format(day, form))

    return let(F.datediff(F.try_to_timestamp(hit, F.lit(form)).cast("date"), first), moved)


def _day_first(hit: Column, key: str, inverse: bool) -> Column:
    """dd/MM/yyyy with a day above 12. Days are counted without the first 12 of each month, so that the pseudonym has
    such a day too and can't be read month first."""
    first = F.lit("1700-01-01").cast("date")

    def counted(day: Column) -> Column:
        month = (F.year(day) - 1700) * 12 + F.month(day)
        return F.when(F.dayofmonth(day) > 12, F.datediff(day, first) - 12 * month)

    def written(n: Column) -> Column:
        near = F.floor(n * 4800 / _LATE).cast("int")
        begins = lambda m: F.datediff(F.add_months(first, m), first) - 12 * m <= n
        month = F.array_max(F.filter(F.array(near - 1, near, near + 1), begins))
        return F.date_format(F.date_add(first, (n + 12 * (month + 1)).cast("int")), "dd/MM/yyyy")

    def moved(n: Column) -> Column:
        cycle = F.floor(n / _LATE).cast("int")
        inside = n - cycle * _LATE
        pair = permute_pair(F.floor(inside / _LATE_B), inside % _LATE_B, _LATE_A, _LATE_B, key, "day first", inverse)
        return F.when(n.isNotNull(), let(let(pair, lambda p: cycle * _LATE + p["a"] * _LATE_B + p["b"]), written))

    return let(let(F.try_to_timestamp(hit, F.lit("dd/MM/yyyy")).cast("date"), counted), moved)


def _email(hit: Column, key: str, inverse: bool) -> Column:
    name, domain = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
    return F.concat(let(name, lambda n: permute_string(n, key, "email", inverse)), F.lit("@"), domain)


def _kind(hit: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(F.rlike(hit, F.lit(f"^(?:{pattern})$")), kind).otherwise(out)
    return out


def _pseudonym(hit: Column, kind: Column, key: str, inverse: bool) -> Column:
    """The pseudonym, or null where the value fails its check."""
    return (
        F.when(kind == "email", _email(hit, key, inverse))
        .when(kind == "card", _card(hit, key, inverse))
        .when(kind == "phone", _phone(hit, key, inverse))
        .when(kind == "ssn", _ssn(hit, key, inverse))
        .when(kind == "ip", _ip(hit, key, inverse))
        .when(F.rlike(hit, F.lit("^[0-9]{4}-")), _date(hit, "yyyy-MM-dd", key, inverse))
        .when(F.rlike(hit, F.lit("[.]")), _date(hit, "dd.MM.yyyy", key, inverse))
        .otherwise(F.coalesce(_date(hit, "MM/dd/yyyy", key, inverse), _day_first(hit, key, inverse)))
    )


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", inverse: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text with pseudonyms, and ``found``: kind, start, end (code points of
    the given text, end exclusive) and value put there.

    Null and empty texts give an empty text and nothing found; values that fail their check stay as they are; repeated
    rows give equal rows; other columns are not looked at.
    """
    text = text_of(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    some = F.rlike(F.col("_text"), F.lit("[0-9@]"))
    cuts = base.select(
        "doc_id",
        F.when(some, F.split("_text", ANY, -1)).otherwise(F.array("_text")).alias("_gaps"),
        F.when(some, F.regexp_extract_all("_text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("_hits"),
    )

    def look(gap: Column, hit: Column) -> Column:
        def named(kind: Column) -> Column:
            new = F.when(hit.isNotNull(), _pseudonym(hit, kind, key, inverse))
            return F.struct(kind.alias("kind"), hit.alias("old"), gap.alias("gap"), new.alias("new"))

        return let(_kind(hit), named)

    seen = cuts.select("doc_id", F.zip_with("_gaps", "_hits", look).alias("_seen"))
    text = F.array_join(F.transform("_seen", lambda s: F.concat(s["gap"], F.coalesce(s["new"], s["old"], F.lit("")))), "")
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>").alias("out"))

    def place(acc: Column, s: Column) -> Column:
        begin = acc["at"] + F.char_length(s["gap"])
        end = begin + F.coalesce(F.char_length(s["old"]), F.lit(0))
        one = F.array(F.struct(s["kind"].alias("kind"), begin.alias("start"), end.alias("end"), s["new"].alias("value")))
        return F.struct(end.alias("at"), F.when(s["new"].isNotNull(), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return seen.select("doc_id", text.alias("text"), F.aggregate("_seen", start, place, lambda a: a["out"]).alias("found"))
