"""Format-preserving pseudonyms: keyed Feistel permutations of validated numbers and dates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapegrid.llm.text import whole

ROUNDS = 8

# The shapes that are looked for. One scan finds all of them; validation follows.
EMAIL = r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9])"
SOCIAL = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
PHONE = r"(?<![0-9])(?:\+?1[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.\-])[0-9]{3}[.\-][0-9]{4}(?![0-9])"
HEX = r"(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9A-Za-z])"
CLOUD_KEY = r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
# A date that is one, so that the end of a card and an expiry do not pass for it.
DAY, MONTH = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])"
TRUE_DATE = rf"(?:(?:19|20)[0-9]{{2}}-{MONTH}-{DAY}|{DAY}[./]{MONTH}[./](?:19|20)[0-9]{{2}})(?![0-9])"
# Groups of digits, 13 digits at least, up to where another shape begins. Cards are looked for inside.
JOINT = "[ \\-](?!" + "|".join([EMAIL, CLOUD_KEY, HEX, TRUE_DATE, SOCIAL, IP, PHONE]) + ")"
RUN = f"(?<![0-9])(?=[0-9](?:(?:{JOINT})?[0-9]){{12}})[0-9]++(?:(?:{JOINT})[0-9]++)*+"
CARD_DIGITS = range(13, 20)
# Groupings in which cards are printed, told apart from those that any digits may have.
PRINTED = r"^(?:[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5}|[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{5})$"
PRINTED_19 = r"^[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}\1[0-9]{3}$"
SHAPES = "|".join([EMAIL, CLOUD_KEY, HEX, DATE, SOCIAL, IP, PHONE, RUN])
# Every shape holds one of these, so a text without them needs no closer scan.
HINTS = "[0-9@]|AKIA|[a-f]{32}"
WINDOW_DAYS = 65_536
FIRST_DAY = "1900-01-01"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _power(width: Column) -> Column:
    """10 to a whole power, exact up to 18."""
    return F.rpad(F.lit("1"), (width + 1).cast("int"), "0").cast("bigint")


def _digest_number(key: str, *parts: Column) -> Column:
    """60 keyed pseudo-random bits of the joined parts."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def _feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: str) -> Column:
    """Keyed permutation of pairs (left, right) with left < left_size and right < right_size.

    In each round one half is shifted, modulo its own size, by a digest of the other half, and the
    halves change places. An even number of rounds gives both back in their own place.
    """
    start = F.struct(
        left.cast("bigint").alias("a"),
        right.cast("bigint").alias("b"),
        left_size.cast("bigint").alias("m"),
        right_size.cast("bigint").alias("n"),
    )

    def step(acc: Column, number: Column) -> Column:
        shift = F.pmod(_digest_number(key, F.lit(kind), number, acc["m"], acc["b"]), acc["m"])
        return F.struct(
            acc["b"].alias("a"),
            ((acc["a"] + shift) % acc["m"]).alias("b"),
            acc["n"].alias("m"),
            acc["m"].alias("n"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 36 digits to one of the same length, one to one."""
    def halves(digits: Column) -> Column:
        width = F.length(digits)
        half = F.floor(width / 2).cast("int")
        rest = (width - half).cast("int")
        left, right = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, rest)
        mixed = _feistel(left.cast("bigint"), right.cast("bigint"), _power(half), _power(rest), key, kind)
        return _let(
            mixed,
            lambda out: F.concat(
                F.lpad(out["a"].cast("string"), half, "0"), F.lpad(out["b"].cast("string"), rest, "0")
            ),
        )

    return _let(digits, halves)


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit."""
    def total_of(digits: Column) -> Column:
        def add(total: Column, place: Column) -> Column:
            digit = F.substring(digits, place, F.lit(1)).cast("int")
            twice = digit * 2
            doubled = twice - F.when(twice > 9, 9).otherwise(0)
            return total + F.when((F.length(digits) - place) % 2 == 1, doubled).otherwise(digit)

        return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)

    return _let(digits, total_of)


def _refilled(shape: Column, digits: Column) -> Column:
    """The digits of ``shape`` replaced in order; everything else stays."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def filled(digits: Column) -> Column:
        def put(acc: Column, place: Column) -> Column:
            one = F.substring(shape, place, F.lit(1))
            is_digit = one.between("0", "9")
            return F.struct(
                F.concat(
                    acc["out"], F.when(is_digit, F.substring(digits, acc["next"], F.lit(1))).otherwise(one)
                ).alias("out"),
                (acc["next"] + F.when(is_digit, 1).otherwise(0)).cast("int").alias("next"),
            )

        return F.aggregate(F.sequence(F.lit(1), F.length(shape)), start, put)["out"]

    return _let(digits, filled)


def _part(text: Column, start: int, length: int) -> Column:
    return F.substring(text, F.lit(start), F.lit(length))


def _is_card(value: Column) -> Column:
    """Whether digits pass the Luhn check and are not all zero."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return _let(digits, lambda d: (_luhn_sum(d) % 10 == 0) & d.rlike("[1-9]"))


def card_pseudonym(value: Column, key: str) -> Column:
    """13 to 19 digits that pass the Luhn check: all but the check digit are permuted."""
    digits = F.regexp_replace(value, "[^0-9]", "")

    def checked(body: Column) -> Column:
        return F.concat(body, F.pmod(-_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))

    body = _let(digits, lambda d: permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card"))
    return F.when(_is_card(value), _refilled(value, _let(body, checked)))


def _first_fit(windows: Column) -> Column:
    """Of windows in the order of their first group those that begin after the last one taken."""
    none = F.filter(windows, lambda w: F.lit(False))
    return F.aggregate(
        windows,
        F.struct(F.lit(0).alias("end"), none.alias("taken")),
        lambda acc, w: F.when(w["first"] < acc["end"], acc).otherwise(
            F.struct(
                (w["first"] + w["groups"]).alias("end"), F.concat(acc["taken"], F.array(w)).alias("taken")
            )
        ),
    )["taken"]


def _card_at(cards: Column) -> Column:
    """Per group, up to the last card: the number of the card that begins there, -2 inside, -1 outside."""

    def marks(card: Column, number: Column) -> Column:
        last = F.get(cards, number - 1)
        end = F.when(number == 0, F.lit(0)).otherwise(last["first"] + last["groups"])
        return F.concat(
            F.array_repeat(F.lit(-1), card["first"] - end),
            F.array(number),
            F.array_repeat(F.lit(-2), card["groups"] - 1),
        )

    return F.flatten(F.transform(cards, marks))


def _cards_inside(run: Column) -> Column:
    """The cards of a run of digit groups, as ``(first group, rank, longest first, groups, card)``.

    A card is 13 to 19 digits from the start of a group to the end of one that pass the Luhn check.
    Cards that overlap give way: printed groupings stand before others, then the left one before the
    right one, then the longer before the shorter. Two scans from the left find them.
    """
    # The next 19 digits from every group on, as far as whole groups go.
    tails = F.regexp_extract_all(
        run, F.lit(r"(?<![0-9])(?=([0-9](?:[ \-]?[0-9]){0,18}(?![0-9]))?)(?=[0-9])"), 1
    )

    def windows(tail: Column, place: Column) -> Column:
        cut = [F.regexp_extract(tail, rf"^[0-9](?:[ \-]?[0-9]){{{n - 1}}}(?![0-9])", 0) for n in CARD_DIGITS]
        valid = F.filter(F.array(*cut), lambda c: F.when(c == "", False).otherwise(_is_card(c)))
        return F.transform(
            valid,
            lambda c: F.struct(
                place.alias("first"),
                F.when(c.rlike(PRINTED), 0).when(c.rlike(PRINTED_19), 1).otherwise(2).alias("rank"),
                (-F.length(F.regexp_replace(c, "[^0-9]", ""))).alias("longest"),
                F.size(F.split(c, r"[ \-]")).alias("groups"),
                c.alias("card"),
            ),
        )

    def free(window: Column, taken: Column) -> Column:
        places = F.sequence(window["first"], window["first"] + window["groups"] - 1)
        return ~F.exists(places, lambda p: F.coalesce(F.get(taken, p), F.lit(-1)) != -1)

    def both(ranked: Column, printed: Column) -> Column:
        others = _let(
            _card_at(printed),
            lambda taken: F.filter(ranked, lambda w: F.when(w["rank"] < 2, False).otherwise(free(w, taken))),
        )
        return F.sort_array(F.concat(printed, _let(others, _first_fit)))

    def settled(ranked: Column) -> Column:
        printed = _let(F.filter(ranked, lambda w: w["rank"] < 2), _first_fit)
        return _let(printed, lambda found: both(ranked, found))

    return _let(F.sort_array(F.flatten(F.transform(tails, windows))), settled)


def _answer(text: Column, found: Column, replaced: Column) -> Column:
    return F.struct(text.alias("text"), found.cast("int").alias("found"), replaced.cast("int").alias("replaced"))


def run_pseudonym(run: Column, key: str) -> Column:
    """``text, found, replaced`` of a run of digit groups: its cards replaced, the rest as it is.

    A run without a card counts as found where it is no longer than one.
    """
    groups = F.regexp_extract_all(run, F.lit(r"[0-9]+[ \-]?"), 0)

    def filled(groups: Column, cards: Column, card_at: Column) -> Column:
        def with_end(card: Column) -> Column:
            last = F.get(groups, card["first"] + card["groups"] - 1)
            return F.concat(card["new"], F.regexp_extract(last, r"[ \-]$", 0))

        def group(one: Column, place: Column) -> Column:
            return _let(
                F.get(card_at, place),
                lambda number: F.when(number >= 0, with_end(F.get(cards, number)))
                .when(number == -2, F.lit(""))
                .otherwise(one),
            )

        return F.array_join(F.transform(groups, group), "")

    def put(cards: Column) -> Column:
        text = _let(groups, lambda g: _let(_card_at(cards), lambda at: filled(g, cards, at)))
        changed = F.filter(cards, lambda c: c["new"] != c["card"])
        short = F.length(F.regexp_replace(run, "[^0-9]", "")) <= CARD_DIGITS[-1]
        return F.when(F.size(cards) == 0, _answer(run, short, F.lit(0))).otherwise(
            _answer(text, F.size(cards), F.size(changed))
        )

    def renewed(cards: Column) -> Column:
        return F.transform(
            cards,
            lambda c: F.struct(
                c["first"].alias("first"),
                c["groups"].alias("groups"),
                c["card"].alias("card"),
                card_pseudonym(c["card"], key).alias("new"),
            ),
        )

    def alone(new: Column) -> Column:
        return _answer(F.coalesce(new, run), F.lit(1), F.coalesce(new != run, F.lit(False)))

    one_group = ~run.rlike(r"[ \-]") & (F.length(run) <= CARD_DIGITS[-1])
    card = F.when(run.rlike(PRINTED), card_pseudonym(run, key))
    return _let(
        card,
        lambda new: F.when(new.isNotNull() | one_group, alone(new)).otherwise(_let(renewed(_cards_inside(run)), put)),
    )


def phone_pseudonym(value: Column, key: str) -> Column:
    """Ten digits, area from 2: the digits but the first of area and exchange are permuted."""
    def new_number(all_digits: Column) -> Column:
        digits = F.substring(all_digits, -10, 10)
        kept = F.substring(all_digits, F.lit(1), F.length(all_digits) - 10)
        body = permuted_digits(F.concat(_part(digits, 2, 2), _part(digits, 5, 6)), key, "phone")
        return _let(
            body,
            lambda b: F.concat(kept, _part(digits, 1, 1), _part(b, 1, 2), _part(digits, 4, 1), _part(b, 3, 6)),
        )

    return _refilled(value, _let(F.regexp_replace(value, "[^0-9]", ""), new_number))


def social_pseudonym(value: Column, key: str) -> Column:
    """Area 001-899 but 666, group and serial not zero; permuted within the valid numbers."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    area, group, serial = (_part(digits, s, n).cast("int") for s, n in ((1, 3), (4, 2), (6, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    rest = (group - 1) * 9_999 + serial - 1

    def written(out: Column) -> Column:
        new_area = out["a"] + 1 + F.when(out["a"] + 1 >= 666, 1).otherwise(0)
        new_group = F.floor(out["b"] / 9_999) + 1
        new_serial = out["b"] % 9_999 + 1
        return F.concat(
            F.lpad(new_area.cast("string"), 3, "0"),
            F.lpad(new_group.cast("string"), 2, "0"),
            F.lpad(new_serial.cast("string"), 4, "0"),
        )

    new = _let(_feistel(place, rest, F.lit(898), F.lit(99 * 9_999), key, "social"), written)
    return F.when(valid, _refilled(value, new))


def ip_pseudonym(value: Column, key: str) -> Column:
    """Four octets up to 255, permuted as two 16-bit halves."""
    octets = F.split(value, r"\.")
    number = [F.element_at(octets, i).cast("int") for i in (1, 2, 3, 4)]
    valid = (number[0] < 256) & (number[1] < 256) & (number[2] < 256) & (number[3] < 256)
    size = F.lit(65_536)
    out = _feistel(number[0] * 256 + number[1], number[2] * 256 + number[3], size, size, key, "ip")

    def written(out: Column) -> Column:
        parts = [F.floor(out["a"] / 256), out["a"] % 256, F.floor(out["b"] / 256), out["b"] % 256]
        return F.concat_ws(".", *[p.cast("int").cast("string") for p in parts])

    return F.when(valid, _let(out, written))


def date_pseudonym(value: Column, key: str) -> Column:
    """Calendar dates of the 65,536 days from 1900-01-01, permuted among themselves.

    ``YYYY-MM-DD``, ``DD.MM.YYYY`` and ``DD/MM/YYYY``; the same day gets the same day in any of them.
    """
    iso = value.substr(5, 1) == "-"
    year = F.when(iso, _part(value, 1, 4)).otherwise(_part(value, 7, 4))
    month = F.when(iso, _part(value, 6, 2)).otherwise(_part(value, 4, 2))
    day = F.when(iso, _part(value, 9, 2)).otherwise(_part(value, 1, 2))
    date = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")
    start = F.lit(FIRST_DAY).cast("date")
    offset = F.datediff(date, start)
    size = F.lit(256)
    out = _feistel(F.floor(offset / 256), offset % 256, size, size, key, "date")
    new = _let(out, lambda o: F.date_add(start, (o["a"] * 256 + o["b"]).cast("int")))
    mark = value.substr(3, 1)

    def written(day: Column) -> Column:
        return F.when(iso, F.date_format(day, "yyyy-MM-dd")).otherwise(
            F.concat_ws(
                "", F.date_format(day, "dd"), mark, F.date_format(day, "MM"), mark, F.date_format(day, "yyyy")
            )
        )

    return F.when(offset.between(0, WINDOW_DAYS - 1), _let(new, written))


def _hex_of(value: Column, key: str, kind: str, length: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), value), 256), F.lit(1), length)


def email_pseudonym(value: Column, key: str) -> Column:
    """Local part to a keyed name of ten hex digits under a reserved domain."""
    return F.concat(F.lit("u"), _hex_of(F.lower(value), key, "email", F.lit(10)), F.lit("@example.invalid"))


def secret_pseudonym(value: Column, key: str) -> Column:
    """Secrets need no way back: keyed hex digits of the same length and letter case."""
    cloud = value.startswith("AKIA")
    hexed = _hex_of(value, key, "secret", F.when(cloud, 16).otherwise(F.length(value)))
    return F.when(cloud, F.concat(F.lit("AKIA"), F.upper(hexed))).otherwise(hexed)


def pseudonym(value: Column, key: str) -> Column:
    """``text, found, replaced`` of one found value; the value itself where it does not validate."""
    kinds = [
        (value.contains("@"), email_pseudonym(value, key)),
        (value.rlike(f"^(?:{CLOUD_KEY}|{HEX})$"), secret_pseudonym(value, key)),
        (value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{2}[./][0-9]{2}[./][0-9]{4}$"), date_pseudonym(value, key)),
        (value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), social_pseudonym(value, key)),
        (value.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), ip_pseudonym(value, key)),
        (value.rlike(f"^(?:{PHONE})$"), phone_pseudonym(value, key)),
    ]
    chosen = F.when(kinds[0][0], kinds[0][1])
    for test, new in kinds[1:]:
        chosen = chosen.when(test, new)
    shaped = F.lit(False)
    for test, _ in kinds:
        shaped = shaped | test
    single = _let(
        F.coalesce(chosen, value), lambda new: _answer(new, F.lit(1), new != value)
    )
    return F.when(shaped, single).otherwise(run_pseudonym(value, key))


def pseudonymise(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "change-me"
) -> DataFrame:
    """``doc_id, text, n_found, n_replaced``: every row with its private values replaced.

    Equal values get equal pseudonyms in every document under one key, and different values of a
    kind different ones: cards (Luhn), phones, social security numbers, IPv4 addresses and dates are
    permuted among the valid values of their format. Mail addresses and secrets get keyed names.
    Values that do not validate stay. Neighbouring numbers hide nothing: digit groups joined by single
    blanks or hyphens are searched for cards at every group, and end where another shape begins. Null text stays null, with counts 0; other columns are
    ignored. Everything is a JVM expression of the row: no shuffle.
    """
    text = whole(text_col)
    nothing = F.array().cast("array<string>")
    found = F.when(text.rlike(HINTS), F.regexp_extract_all(text, F.lit(SHAPES), 0)).otherwise(nothing)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), found.alias("_found")
    )
    fresh = F.transform("_found", lambda v: pseudonym(v, key))
    pieces = F.split("_text", SHAPES, -1)
    joined = F.concat_ws(
        "", F.flatten(F.zip_with(pieces, "_fresh", lambda p, v: F.array(p, F.coalesce(v["text"], F.lit("")))))
    )

    def total(count: str) -> Column:
        return F.coalesce(F.aggregate("_fresh", F.lit(0), lambda t, v: t + v[count]), F.lit(0)).cast("long")

    return rows.withColumn("_fresh", fresh).select(
        "doc_id",
        F.when(F.size("_found") > 0, joined).otherwise(F.col("_text")).alias("text"),
        total("found").alias("n_found"),
        total("replaced").alias("n_replaced"),
    )
