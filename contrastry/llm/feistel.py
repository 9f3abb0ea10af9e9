"""Format-preserving pseudonyms for personal data, all in DataFrame expressions.

Card numbers (Luhn-valid), calendar dates, phone numbers, network addresses, e-mail names
and quoted access keys are found by one pattern, validated, and permuted by a keyed Feistel
network inside their own format: a card stays Luhn-valid, a date stays a date, letters stay
letters. The network is a bijection on each format, so equal values stay linked across
documents and different values stay different; it holds no table of values and shuffles
nothing.

The network works on an array of digits with a radix for each place: one half is added,
place by place, to a keystream that SHA-512 derives from the key, the kind of value, the round
and the other half. Dates are two digits with radices 189 and 773, whose product is the number
of days in a 400-year calendar cycle. Only dates are walked: days up to 12 and later days of a
month stay apart, as dates with days up to 12 can be read day first and month first.

Defined results: a NULL text stays NULL, an empty text stays empty, numbers that fail their
validation stay as they are, repeated rows get equal results. Further columns pass through;
columns named like the results are replaced.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastry.llm.inputs import let, table

ROUNDS = 8
#: Session settings: the key itself, or a file whose first line it is. Their names fall under Spark's redaction.
KEY_SETTING, KEY_FILE_SETTING = "spark.contrastry.pseudonym.secret", "spark.contrastry.pseudonym.secret.file"

#: Alphabets inside which a character is permuted, and the shapes of the values.
DIGITS = ("0123456789",)
HEX = ("0123456789abcdef", "ABCDEF")
LETTERS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: A further digit of a phone number, its separators before it; a card in groups does not belong to it.
DIGIT = r"(?:(?:[ ./-]?\(|\)[ ./-]?|[ ./-])(?![0-9]{13}|(?:[0-9]{4}[ -]){3}[0-9]|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4}))?[0-9]"
TRUNK = r"(?:[ ./-]?\(0\))?"
#: Country codes whose numbers have a fixed length; others have 8 to 15 digits in all.
PLANS = [rf"(?:{codes}){TRUNK}(?:{DIGIT}){{{size}}}" for codes, size in (("[17]|44|91", 10), ("3[0134]|41|48|61", 9), ("45|47|65", 8))]
COUNTRY = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
#: Three, three and four digits with an area code from 200; or a trunk zero, a separated area code and 9 to 11 digits in all.
BOUNDS = r"(?<![0-9+])(?<![0-9][.-])", r"(?![0-9]|[.-][0-9])"
AREA_FIRST = "(?:" + "|".join([
    r"(?:1[ .-])?(?:\([2-9][0-9]{2}\)[ .-]?|[2-9][0-9]{2}[.-])[0-9]{3}[ .-][0-9]{4}".join(BOUNDS),
    # with spaces alone it must not stand among other figures
    r"(?<![0-9] )(?:1 )?[2-9][0-9]{2} [0-9]{3}[ .-][0-9]{4}(?! [0-9])".join(BOUNDS),
]) + ")"
TRUNK_FIRST = r"(?=\(?0[1-9][0-9]{0,4}\)?[ /-][0-9])\(?0[1-9](?:\)?[ /-]?[0-9]){7,9}".join(BOUNDS)
NATIONAL = f"{AREA_FIRST}|{TRUNK_FIRST}"
SHAPES = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "secret": r"(?<=(?:token|secret|password|passwd|api_key|apikey|access_key)\s?[=:]\s?[\"'])[0-9a-fA-F]{16,}(?=[\"'])",
    "address": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "phone": rf"(?<![0-9])\+(?:{'|'.join(PLANS)}|[1-9](?:{DIGIT}){{7,14}})(?![0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}(?:-[0-9]{1,2}-|/[0-9]{1,2}/)[0-9]{1,2}|(?:[0-9]{1,2}[./][0-9]{1,2}[./]|[0-9]{1,2}-[0-9]{1,2}-)[0-9]{4})(?![0-9/-])",
}
#: A whole run of digit groups; short numbers may stand beside the card. Where a date, address, e-mail name or phone number with an area code begins, it ends.
SHAPES["card"] = (
    r"(?<![0-9])(?![0-9]{20})(?=(?:[0-9][ -]?){12}[0-9])[0-9]++(?:[ -]" + rf"(?!{SHAPES['date']}|{SHAPES['address']}|{SHAPES['email']}|{AREA_FIRST})" + r"[0-9]++)*+"
)
CARD_DIGITS = range(13, 20)
#: First digits and lengths of card numbers by issuer, and the ways in which they are grouped.
ISSUERS = "|".join([
    "4[0-9]{12}(?:[0-9]{3}){0,2}", "(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}", "3[47][0-9]{13}", "3(?:0[0-5]|[689][0-9])[0-9]{11}",
    "(?:6011|64[4-9][0-9]|65[0-9]{2})[0-9]{12,15}", "35(?:2[89]|[3-8][0-9])[0-9]{12,15}", "62[0-9]{14,17}", "(?:5018|5020|5038|5893|6304|6759|676[1-3])[0-9]{9,15}",
])
SHORT_RUN = 8
LAYOUTS = {5: "4-4-4-4-3", 4: "4-4-4-4", 3: "4-6-5|4-6-4|4-4-5", 1: "1[3-9]"}
ANY = "|".join([*list(SHAPES.values())[:-1], AREA_FIRST, SHAPES["card"], TRUNK_FIRST])
KINDS = tuple(SHAPES)
CYCLE_DAYS = 146_097
DATE_RADICES = (189, 773)
#: Days from the epoch to 1700-01-01, where the 400-year cycle in use begins.
CYCLE_START = -98_615


def permute(values: Column, radices: Column, key: str, kind: str) -> Column:
    """Keyed bijection on the digit arrays with the given radices (one array<int> for another)."""
    half = F.floor(F.size(values) / 2).cast("int")

    def first(digits: Column) -> Column:
        return F.slice(digits, F.lit(1), half)

    def rest(digits: Column) -> Column:
        return F.slice(digits, half + 1, F.size(values))

    def add(side: Column, side_radices: Column, stream: Column) -> Column:
        return F.transform(side, lambda digit, i: F.pmod(
            digit + F.conv(F.substring(stream, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.get(side_radices, i)).cast("int"))

    def turn(state: Column, number: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), F.lit(kind), number.cast("string"), F.size(values).cast("string"), F.array_join(state["b"].cast("array<string>"), ","))
        return let(F.sha2(seed.cast("binary"), 512), lambda stream: F.struct(
            state["b"].alias("a"), state["rb"].alias("ra"), add(state["a"], state["ra"], stream).alias("b"), state["ra"].alias("rb")))

    start = F.struct(first(values).alias("a"), first(radices).alias("ra"), rest(values).alias("b"), rest(radices).alias("rb"))
    return let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn), lambda state: F.concat(state["a"], state["b"]))


def permute_text(value: Column, alphabets: tuple[str, ...], key: str, kind: str) -> Column:
    """Each character moves inside its own alphabet; characters of none stay."""
    letters = "".join(alphabets)
    chars = F.filter(F.split(value, ""), lambda c: c != "")

    def place(char: Column) -> Column:
        return F.instr(F.lit(letters), char)

    def of(char: Column, pick) -> Column:
        base, found = 0, F
        for alphabet in alphabets:
            found = found.when(place(char).between(base + 1, base + len(alphabet)), F.lit(pick(base, len(alphabet))))
            base += len(alphabet)
        return found

    def rebuilt(symbols: Column) -> Column:
        digits = F.transform(symbols, lambda c: F.coalesce((place(c) - 1 - of(c, lambda base, _: base)).cast("int"), F.lit(0)))
        radices = F.transform(symbols, lambda c: F.coalesce(of(c, lambda _, size: size), F.lit(1)))
        moved = permute(digits, radices, key, kind)
        return let(moved, lambda m: F.array_join(
            F.transform(symbols, lambda c, i: F.coalesce(F.substring(F.lit(letters), of(c, lambda base, _: base) + F.get(m, i) + 1, F.lit(1)), c)), ""))

    return let(chars, rebuilt)


def luhn_sum(digits: Column, double_from: int) -> Column:
    """Luhn sum from the right; every second digit counts double, beginning with place ``double_from``."""
    def term(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == double_from % 2, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), term)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order; separators stay."""
    def char(c: Column, i: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.substring(digits, F.length(digits_of(F.substring(shape, F.lit(1), i + 1))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(shape, ""), lambda c: c != ""), char), "")


def pseudonym_card(value: Column, key: str) -> Column:
    def swap(digits: Column) -> Column:
        body = permute_text(F.substring(digits, F.lit(1), F.length(digits) - 1), DIGITS, key, "card")
        closed = let(body, lambda b: F.concat(b, F.pmod(10 - luhn_sum(b, 1) % 10, F.lit(10)).cast("string")))
        return F.when(luhn_sum(digits, 2) % 10 == 0, let(closed, lambda d: refill(value, d))).otherwise(value)

    return let(digits_of(value), swap)


def cut(pieces: Column, shape: Column, kind: str) -> Column:
    """``pieces`` (text, kind) with every match of ``shape`` in those without a kind as a piece of its own."""
    def piece(text: Column, name: Column) -> Column:
        return F.struct(text.alias("text"), name.cast("string").alias("kind"))

    def parts(text: Column) -> Column:
        hits = F.regexp_extract_all(text, shape, F.lit(0))
        between = F.split(text, shape, -1)
        return let(hits, lambda h: F.flatten(F.transform(between, lambda b, i: F.array(piece(b, F.lit(None)), piece(F.get(h, i), F.lit(kind))))))

    cuts = F.flatten(F.transform(pieces, lambda p: F.when(p["kind"].isNull(), parts(p["text"])).otherwise(F.array(p))))
    return F.filter(cuts, lambda p: p["text"] != "")


def cut_cards(run: Column) -> Column:
    """Pieces (text, kind) of a run of digit groups, with its cards as pieces of their own.

    A card is an unbroken group or some whole groups in a usual layout, with the first digits and
    length of an issuer and a right check digit. Inside a table of figures groups are none: where
    numbers of more than two digits stand beside them in a run longer than ``SHORT_RUN``, or two of
    four digits in any, unless three cards follow one another there.
    """
    def found(parts: Column, digits: Column) -> Column:
        def size(i: Column) -> Column:
            return F.coalesce(F.length(F.get(digits, i)), F.lit(0))

        def card_groups(group: Column, i: Column) -> Column:
            """Number of groups of the card that begins at group i, or 0."""
            def of(layout: Column) -> Column:
                chain = F
                for groups, shape in LAYOUTS.items():
                    number = F.array_join(F.slice(digits, i + 1, groups), "")
                    chain = chain.when(layout.rlike(f"^(?:{shape})(?:-|$)") & let(number, lambda n: n.rlike(f"^(?:{ISSUERS})$") & (luhn_sum(n, 2) % 10 == 0)), groups)
                return chain.otherwise(0)

            sizes = F.array_join(F.transform(F.slice(digits, i + 1, 5), lambda g: F.length(g).cast("string")), "-")
            return F.when((F.length(group) == 4) | F.length(group).between(CARD_DIGITS[0], CARD_DIGITS[-1]), let(sizes, of)).otherwise(0)

        def chosen(groups: Column) -> Column:
            def kept(starts: Column) -> Column:
                def has(i: Column) -> Column:
                    return F.array_contains(starts, i) & (F.get(groups, i) == 4)

                def alone(i: Column) -> Column:
                    first, behind = F.when(has(i - 4), i - 4).otherwise(i), F.when(has(i + 4), i + 8).otherwise(i + F.get(groups, i))
                    short = F.size(digits) <= SHORT_RUN

                    def side(near: Column, far: Column) -> Column:
                        return (size(near) <= 2) | (short & ~((size(near) == 4) & (size(far) == 4)))

                    return side(first - 1, first - 2) & side(behind, behind + 1)

                def three(i: Column) -> Column:
                    return (has(i - 4) & (has(i - 8) | has(i + 4))) | (has(i + 4) & has(i + 8))

                return F.filter(starts, lambda i: (F.get(groups, i) == 1) | alone(i) | three(i))

            def step(state: Column, i: Column) -> Column:
                return F.when(i >= state["end"], F.struct((i + F.get(groups, i)).alias("end"), F.concat(state["at"], F.array(i)).alias("at"))).otherwise(state)

            starts = F.filter(F.sequence(F.lit(0), F.size(digits) - 1), lambda i: F.get(groups, i) > 0)
            first = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at"))
            return let(starts, lambda s: F.aggregate(let(s, kept), first, step)["at"])

        def pieces(groups: Column) -> Column:
            def stretch(begin: Column, end: Column, kind: str | None) -> Column:
                return F.struct(F.array_join(F.slice(parts, begin + 1, end - begin), "").alias("text"), F.lit(kind).cast("string").alias("kind"))

            def woven(at: Column) -> Column:
                end = lambda k: F.coalesce(F.get(at, k) + F.get(groups, F.get(at, k)), F.lit(0))
                cards = F.transform(at, lambda i, k: F.array(stretch(end(k - 1), i, None), stretch(i, i + F.get(groups, i), "card")))
                return F.concat(F.flatten(cards), F.array(stretch(end(F.size(at) - 1), F.size(parts), None)))

            return let(chosen(groups), woven)

        return let(F.transform(digits, card_groups), pieces)

    def parted(parts: Column) -> Column:
        return let(F.transform(parts, digits_of), lambda digits: found(parts, digits))

    return F.filter(let(F.regexp_extract_all(run, F.lit("[0-9]++[ -]?"), F.lit(0)), parted), lambda p: p["text"] != "")


def pseudonym_phone(value: Column, key: str) -> Column:
    """The country code or trunk digit stays, so that a number has one pseudonym with either."""
    code = F.regexp_extract(value, rf"^(?:\+{COUNTRY}{TRUNK}|1[ .-]|\(?0(?=[1-9]))", 0)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    return F.concat(code, let(permute_text(digits_of(rest), DIGITS, key, "phone"), lambda d: refill(rest, d)))


def pseudonym_email(value: Column, key: str) -> Column:
    """The name before the sign is permuted (in lower case and capitals alike); the domain stays."""
    name = F.substring_index(value, "@", 1)
    return F.concat(permute_text(name, LETTERS, key, "email"), F.substring(value, F.length(name) + 1, F.length(value)))


def pseudonym_address(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda part: part.cast("int"))
    return F.array_join(permute(octets, F.array(*[F.lit(256)] * 4), key, "address").cast("array<string>"), ".")


def calendar_date(value: Column) -> Column:
    """Year first, else day first if that is a date, else month first; NULL for other shapes and impossible dates."""
    def read(parts: Column) -> Column:
        def of(year: int, month: int, day: int) -> Column:
            return F.concat_ws("-", parts[year], F.lpad(parts[month], 2, "0"), F.lpad(parts[day], 2, "0")).try_cast("date")

        return F.when(F.length(parts[0]) == 4, of(0, 1, 2)).otherwise(F.coalesce(of(2, 1, 0), of(2, 0, 1)))

    shape = r"^(?:[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})$"
    return F.when(value.rlike(shape), let(F.split(value, "[./-]"), read))


def calendar_day(value: Column) -> Column:
    """Days since the cycle began; NULL where there is no date."""
    return F.unix_date(calendar_date(value)) - CYCLE_START


def pseudonym_date(value: Column, key: str) -> Column:
    """Inside the 400-year cycle from 1700; other years and impossible dates stay.

    Days up to 12 and later days are permuted among themselves: a date that can be read in one
    order only keeps that order, and one date has one pseudonym in every layout.
    """
    radices = F.array(*[F.lit(r) for r in DATE_RADICES])

    def date_of(day: Column) -> Column:
        return F.date_from_unix_date((day + CYCLE_START).cast("int"))

    def moved(day: Column) -> Column:
        pair = F.array(F.floor(day / DATE_RADICES[1]).cast("int"), F.pmod(day, F.lit(DATE_RADICES[1])).cast("int"))
        return let(permute(pair, radices, key, "date"), lambda p: p[0] * DATE_RADICES[1] + p[1])

    def late(day: Column) -> Column:
        return F.dayofmonth(date_of(day)) > 12

    def walked(day: Column) -> Column:
        """The next day of the same half on the way through the permutation; 60 steps all but never pass without one."""
        start = F.struct(day.alias("at"), F.lit(False).alias("there"))
        step = lambda s, _: F.when(s["there"], s).otherwise(let(moved(s["at"]), lambda m: F.struct(m.alias("at"), (late(m) == late(day)).alias("there"))))
        return F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step)["at"]

    def shown(date: Column) -> Column:
        def write(parts: Column) -> Column:
            width = F.when(F.regexp_count(value, F.lit(r"\b[0-9]\b")) > 0, 1).otherwise(2)
            number = lambda c: let(c.cast("string"), lambda n: F.lpad(n, F.greatest(width, F.length(n)), F.lit("0")))
            year, month, day = F.lpad(F.year(date).cast("string"), 4, "0"), number(F.month(date)), number(F.dayofmonth(date))
            first, last = F.regexp_extract(value, "[./-]", 0), F.regexp_extract(value, "[./-][0-9]+([./-])", 1)
            day_first = F.concat_ws("-", parts[2], F.lpad(parts[1], 2, "0"), F.lpad(parts[0], 2, "0")).try_cast("date").isNotNull()
            return F.when(F.length(parts[0]) == 4, F.concat(year, first, month, last, day)).when(
                day_first, F.concat(day, first, month, last, year)).otherwise(F.concat(month, first, day, last, year))

        return let(F.split(value, "[./-]"), write)

    return let(calendar_day(value), lambda d: F.when((d >= 0) & (d < CYCLE_DAYS), let(date_of(walked(d)), shown)).otherwise(value))


def kind_of(value: Column) -> Column:
    return (
        F.when(value.contains("@"), F.lit("email")).when(value.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.lit("address")).when(value.startswith("+"), F.lit("phone"))
        .when(calendar_day(value).isNotNull(), F.lit("date"))
        .when(value.rlike("^[0-9]{1,19}(?:[ -][0-9]++)*+$") & (F.length(digits_of(value)) >= CARD_DIGITS[0]), F.lit("run"))
        .when(value.rlike(f"^(?:{NATIONAL})$"), F.lit("phone"))
        .when(value.rlike("^[0-9a-fA-F]{20,}$") | value.rlike("[a-fA-F]"), F.lit("secret")).otherwise(F.lit("other"))
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "email", pseudonym_email(value, key)).when(kind == "secret", permute_text(value, HEX, key, "secret")).when(kind == "address", pseudonym_address(value, key))
        .when(kind == "phone", pseudonym_phone(value, key)).when(kind == "date", pseudonym_date(value, key)).when(kind == "card", pseudonym_card(value, key)).otherwise(value)
    )


def rewritten(value: Column, kind: Column, key: str) -> Column:
    """The kinds of the values in a match, and the match rewritten."""
    def run(pieces: Column) -> Column:
        return F.struct(
            F.filter(F.transform(pieces, lambda p: p["kind"]), lambda k: k.isNotNull()).alias("kinds"),
            F.array_join(F.transform(pieces, lambda p: F.when(p["kind"] == "card", pseudonym_card(p["text"], key)).when(p["kind"] == "phone", pseudonym_phone(p["text"], key)).otherwise(p["text"])), "").alias("value"))

    return F.when(kind == "run", let(cut(cut_cards(value), F.lit(NATIONAL), "phone"), run)).otherwise(F.struct(F.array(kind).alias("kinds"), pseudonym(value, kind, key).alias("value")))


def tally(matches: Column, kind: str) -> Column:
    return F.size(F.filter(F.flatten(F.transform(matches, lambda match: match["kinds"])), lambda k: k == kind))


def session_key(spark: SparkSession) -> str:
    """The key that the session names; where it names none, a random one for this session alone."""
    path = spark.conf.get(KEY_FILE_SETTING, None)
    if path:
        return spark.read.text(path).first()[0]
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """``docs`` with the text rewritten and ``n_pseudonyms``, an array of counts in the order of ``KINDS``.

    Without a key the session's is taken; values stay linked across runs only under the same key.
    """
    key = key or session_key(docs.sparkSession)
    body = F.col(text)
    found = F.transform(F.regexp_extract_all(body, F.lit(ANY), F.lit(0)), lambda v: let(kind_of(v), lambda k: rewritten(v, k, key)))

    def woven(matches: Column) -> Column:
        pieces = F.split(body, ANY, -1)
        whole = F.array_join(F.transform(pieces, lambda piece, i: F.concat(piece, F.coalesce(F.get(matches, i)["value"], F.lit("")))), "")
        counts = F.array(*[tally(matches, kind) for kind in KINDS])
        return F.struct(whole.alias("text"), counts.alias("counts"))

    untouched = F.struct(body.alias("text"), F.array(*[F.lit(0)] * len(KINDS)).alias("counts"))
    others = [c for c in docs.columns if c.lower() not in {"n_pseudonyms", "__done"}]
    done = docs.select(*[F.col(f"`{c}`") for c in others], F.when(body.rlike("[0-9@]") & body.rlike(ANY), let(found, woven)).otherwise(untouched).alias("__done"))
    return done.select(*[F.col("__done.text").alias(text) if c == text else F.col(f"`{c}`") for c in others], F.col("__done.counts").alias("n_pseudonyms"))


def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", *[F.col("n_pseudonyms")[i].alias(f"n_{kind}") for i, kind in enumerate(KINDS)])


QUERIES = {"op6_feistel_pseudonyms": op6_feistel_pseudonyms}
SQL: dict[str, str] = {}
