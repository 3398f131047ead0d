"""Facts in listing texts: bedrooms, floor, equipment, heating, currency, dates. Ordered expressions, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numerals in words.
NUMERALS = {"nje": 1, "dy": 2, "tri": 3, "kater": 4, "pese": 5, "gjashte": 6, "shtate": 7, "tete": 8, "nente": 9, "dhjete": 10, "one": 1, "two": 2, "three": 3, "four": 4}
# Months by name and short name.
MONTHS = {
    "janar": 1, "jan": 1, "shkurt": 2, "shk": 2, "mars": 3, "mar": 3, "prill": 4, "pri": 4, "maj": 5, "qershor": 6, "qer": 6, "korrik": 7, "kor": 7, "gusht": 8, "gush": 8,
    "shtator": 9, "sht": 9, "tetor": 10, "tet": 10, "nentor": 11, "nen": 11, "dhjetor": 12, "dhj": 12,
}
# Words of heating kinds, the first kind that occurs deciding.
HEATING = (
    ("CENTRAL", ("qendror", "central", "termo")),
    ("GAS", ("gaz", "gas")),
    ("ELECTRIC", ("elektrik", "electric")),
    ("WOOD", ("dru", "wood", "sobe")),
    ("NONE", ("pa ngrohje", "no heating")),
)
MOST_BEDROOMS = 10

# Beginnings of the words for a room, for sleeping and for sitting, words for bedrooms and studios, and the end of
# a room's word that is joined to its count.
ROOM, SLEEP, SIT = "dhom", ("gjum", "fjet"), ("ndej", "nde", "dit")
BEDS, STUDIO = ("bed", "beds", "bedroom", "bedrooms", "br"), ("garson", "gason", "studio")
JOINED = "she"


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), "ëç", "ec")


def count(token: Column) -> Column:
    """A number in digits or words; null when it is neither or over the most a listing may have."""
    words = F.create_map(*[F.lit(x) for kv in NUMERALS.items() for x in kv])
    n = F.coalesce(F.nullif(token, F.lit("")).try_cast("int"), words[token])
    return F.when(n.between(0, MOST_BEDROOMS), n)


def _starts(word: Column, beginnings: tuple[str, ...] | str) -> Column:
    marks = (beginnings,) if isinstance(beginnings, str) else beginnings
    out = F.lit(False)
    for m in marks:
        out = out | F.coalesce(F.startswith(word, F.lit(m)), F.lit(False))
    return out


def bedrooms(*texts: Column) -> Column:
    """The first text that tells the number of bedrooms, titles before descriptions.

    A text becomes a list of words, numbers and the signs + and :. Around each place a few words decide, and the kinds of
    evidence come in this order: a layout (2+1), a field (rooms: 2), sleeping rooms with a count before or after, a count
    joined to its rooms, rooms that are not for sitting, beds; then one sleeping room without a count, and none in a studio.
    """

    def of(text: Column) -> Column:
        t = F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit("([a-z]+|[0-9]+|[+:])"), F.lit(1))
        # Each place with the three behind it; one pass keeps the first value of each kind of evidence.
        places = F.arrays_zip(t.alias("w0"), *[F.slice(t, k + 1, F.size(t)).alias(f"w{k}") for k in (1, 2, 3)])
        digits = lambda w: F.when(w.rlike("^[0-9]{1,2}$"), count(w))
        room = lambda w: _starts(w, ROOM)
        link = lambda w: F.coalesce(w.isin("te", "e"), F.lit(False))
        sleeping = lambda at, k: _starts(at(k), SLEEP) | (link(at(k)) & _starts(at(k + 1), SLEEP))
        sitting = lambda at, k: (at(k) == "e") & _starts(at(k + 1), SIT)
        after = lambda at, k: digits(F.when(at(k) == ":", at(k + 1)).otherwise(at(k)))
        whole = lambda w: F.coalesce(*[F.when(F.startswith(w, F.lit(name + ROOM)) & F.endswith(w, F.lit(JOINED)), n) for name, n in NUMERALS.items()])
        kinds = [
            lambda at: F.when((at(1) == "+") & at(2).rlike("^[0-9]"), digits(at(0))),
            lambda at: F.when(room(at(0)) & (at(1) == ":"), digits(at(2))),
            lambda at: F.when(room(at(1)) & sleeping(at, 2), count(at(0))),
            lambda at: F.when(room(at(0)) & _starts(at(1), SLEEP), after(at, 2)),
            lambda at: F.coalesce(whole(at(0)), F.when(room(at(1)) & F.endswith(at(1), F.lit(JOINED)), count(at(0)))),
            lambda at: F.when(room(at(1)) & ~F.coalesce(sitting(at, 2), F.lit(False)), count(at(0))),
            lambda at: F.when(at(1).isin(*BEDS), count(at(0))),
            lambda at: F.when(room(at(0)) & sleeping(at, 1), F.lit(1)),
            lambda at: F.when(_starts(at(0), STUDIO[:2]) | (at(0) == STUDIO[2]), F.lit(0)),
        ]
        nothing = F.struct(*[F.lit(None).cast("int").alias(f"k{j}") for j in range(len(kinds))])

        def step(found: Column, place: Column) -> Column:
            return F.struct(*[F.coalesce(found[f"k{j}"], kind(lambda k: place[f"w{k}"])).cast("int").alias(f"k{j}") for j, kind in enumerate(kinds)])

        return F.aggregate(places, nothing, step, lambda found: F.coalesce(*[found[f"k{j}"] for j in range(len(kinds))]))

    return F.coalesce(*[of(t) for t in texts])


def sane_bedrooms(n: Column, area: Column, price: Column) -> Column:
    """Null where the number cannot be one of bedrooms: over the most, or the area or the price in its place."""
    leaked = F.coalesce((n >= 5) & (n == area.cast("int")), F.lit(False)) | F.coalesce((n >= 5) & (n == price.cast("long")), F.lit(False))
    return F.when((n < 0) | (n > MOST_BEDROOMS) | leaked, F.lit(None)).otherwise(n)


def equipment(text: Column) -> Column:
    """Struct of floor, is_furnished, has_elevator, has_parking; null where the text is silent."""
    t = folded(F.coalesce(text, F.lit("")))
    furnished = F.when(t.rlike(r"pa\s+mobil"), False).when(t.rlike("mobiluar|mobilim"), True)
    return F.struct(
        F.nullif(F.regexp_extract(t, r"katin e (\d+)", 1), F.lit("")).try_cast("int").alias("floor"),
        furnished.alias("is_furnished"),
        F.when(t.contains("ashensor"), True).alias("has_elevator"),
        F.when(t.rlike("parking|garazh"), True).alias("has_parking"),
    )


def heating(field: Column, description: Column) -> Column:
    """From the field anywhere in it, else whole words of the description; UNKNOWN if both are silent, null if both are missing.

    One table of (kind, mark); the first mark of the table that stands in the text decides.
    """
    table = [(kind, mark) for kind, marks in HEATING for mark in marks]
    marks = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(m).alias("mark")) for k, m in table])
    plain = lambda x: F.coalesce(folded(x), F.lit(""))
    spaced = F.concat(F.lit(" "), F.regexp_replace(plain(description), "[^a-z0-9]+", " "), F.lit(" "))
    in_field = F.get(F.filter(marks, lambda m: F.contains(plain(field), m["mark"])), 0)["kind"]
    in_text = F.get(F.filter(marks, lambda m: F.contains(spaced, F.concat(F.lit(" "), m["mark"], F.lit(" ")))), 0)["kind"]
    return F.coalesce(in_field, in_text, F.when((plain(field) != "") | (plain(description) != ""), "UNKNOWN"))


def currency(field: Column, description: Column) -> Column:
    named = F.upper(F.trim(field))
    t = F.lower(description)
    found = F.when(named.isin("EUR", "USD", "CHF"), named)
    return F.coalesce(found, F.when(t.rlike(r"\$|usd"), "USD"), F.when(t.contains("chf"), "CHF"), F.lit("EUR"))


def day(raw: Column) -> Column:
    """dd/MM/yyyy with or without a time, or ISO; null if neither."""
    t = F.trim(raw)
    return F.coalesce(
        F.try_to_timestamp(t, F.lit("dd/MM/yyyy HH:mm")).cast("date"), F.try_to_timestamp(t, F.lit("dd/MM/yyyy")).cast("date"), F.try_to_timestamp(t).cast("date")
    )


def named_day(raw: Column) -> Column:
    """'12 Korrik 2026' and the like; the month's name may be cut short. Null if the parts are no date."""
    t = folded(F.trim(raw))
    word = F.regexp_extract(t, r"^(\d{1,2})\W+([a-z]+)\W+(\d{4})", 2)
    month = F.coalesce(*[F.when((word != "") & (F.startswith(word, F.lit(n)) | F.startswith(F.lit(n), word)), m) for n, m in MONTHS.items()])
    part = lambda i: F.regexp_extract(t, r"^(\d{1,2})\W+([a-z]+)\W+(\d{4})", i)
    return F.try_to_timestamp(F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(1), 2, "0")), F.lit("yyyy-MM-dd")).cast("date")


def iso_week(d: Column) -> Column:
    """2026-W07: year and week of ISO 8601."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d))
