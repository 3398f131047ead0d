"""Text columns: redaction, cleaning, numbers in text, markers, ordered rules, HTML and URLs. All built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[redacted]"
# Messengers by name, and hosts of links to a person.
MESSENGERS = ("whatsapp", "viber", "telegram", "signal", "messenger", "instagram", "skype")
HOSTS = ("wa.me/", "whatsapp.com/", "t.me/", "telegram.me/", "m.me/", "viber.com/", "viber://", "instagram.com/", "facebook.com/messages/")
MAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
# First digits of mobile numbers, with or without the country's code.
MOBILE = "(?:4[3-9]|2[89]|3[89])"
#: A number that starts with + or 0 and has eight digits or more; a mobile number of eight to ten digits, parted or not, with the
#: country's code or without; groups of three, three and four. Marks between groups are not the points of an amount.
PHONE = (
    r"(?:\+|\b0)[0-9](?:[ ()./-]{0,2}[0-9]){6,13}|\b(?:383[ ./-]?)?" + MOBILE + r"[ /-]?[0-9](?:[ /-]?[0-9]){5,7}\b|\b[0-9]{3}[ /-][0-9]{3}[ /-][0-9]{4}\b"
)


def _contact(word: Column) -> Column:
    """Whether a word is a link to a person or an address."""
    hosts = F.lit(False)
    for h in HOSTS:
        hosts = hosts | F.contains(word, F.lit(h))
    return hosts | word.rlike(MAIL)


def _names(word: Column) -> Column:
    """Whether a word is a messenger's name that a handle follows, in the same word or the next."""
    bare = F.regexp_replace(word, r"[:@].*$", "")
    return (bare != word) & bare.isin(*MESSENGERS)


def redacted(text: Column, longest: int | None = None) -> Column:
    """Contact data masked word by word: links and addresses, what follows a messenger's name, and phone numbers.

    Punctuation after a masked word stays; white space becomes one space; the text is cut with an ellipsis. Null gives an
    empty text.
    """
    words = F.split(collapsed(F.coalesce(text, F.lit(""))), " ")
    # Each word with the one before it, so that the words are parted twice and not once a word.
    pairs = F.arrays_zip(words.alias("w"), F.concat(F.array(F.lit("")), words).alias("b"))
    told = lambda w: w.rlike(r"[:@]$")

    def of(p: Column) -> Column:
        now, before = F.lower(p["w"]), F.lower(p["b"])
        mask = F.concat(F.lit(REDACTED), F.regexp_extract(p["w"], r"[,;!?)]*$", 0))
        return F.when(_contact(now) | (_names(now) & ~told(now)) | (_names(before) & told(before)), mask).when(_names(now), F.lit("")).otherwise(p["w"])

    kept = F.filter(F.transform(pairs, of), lambda w: w.isNotNull() & (w != ""))
    out = F.regexp_replace(F.array_join(kept, " "), PHONE, REDACTED)
    return out if longest is None else F.when(F.length(out) > longest, F.concat(F.substring(out, 1, longest), F.lit("…"))).otherwise(out)


def redacted_provenance(provenance: Column, snippet: int = 120, value: int = 200) -> Column:
    """A map of fields to structs (value, snippet, ...) with both texts masked and cut."""
    return F.transform_values(provenance, lambda _, e: e.withField("snippet", redacted(e["snippet"], snippet)).withField("value", redacted(e["value"], value)))


#: Keys of an agent that hold a name, in order.
AGENT_NAMES = ("fullName", "name", "agencyName")


def public_agent(agent: Column) -> Column:
    """What may be shown of an agent (a variant): fullName, the first name it has. Null if it has none or is no object."""
    names = [F.nullif(F.try_variant_get(agent, f"$.{k}", "string"), F.lit("")) for k in AGENT_NAMES]
    return F.when(F.coalesce(*names).isNotNull(), F.struct(F.coalesce(*names).alias("fullName")))


def without_contacts(extra: Column) -> Column:
    """An object of further fields (JSON) with its agent cut down to what may be shown; {} for null, blank and no object."""
    fields = F.from_json(extra, "map<string,variant>")
    kept = F.map_filter(fields, lambda k, _: k != "agent")
    shown = F.to_json(public_agent(fields["agent"]))
    agent = F.create_map(F.lit("agent"), F.when(shown.isNull(), F.parse_json(F.lit("null"))).otherwise(F.try_parse_json(shown)))
    return F.coalesce(F.to_json(F.when(F.map_contains_key(fields, "agent"), F.map_concat(kept, agent)).otherwise(fields)), F.lit("{}"))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))


#: Letters with marks and what they fold to.
MARKED, PLAIN = "áàâäçéèêëíìîïñóòôöúùûüß", "aaaaceeeeiiiinoooouuuus"


def key(text: Column) -> Column:
    """Lower case, marks folded, everything but letters and digits a single space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), "[^a-z0-9]+", " "))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def number(token: Column) -> Column:
    """A number written with dots or commas: groups of three digits are thousands, else the last mark is the decimal one."""
    return bound(F.regexp_replace(F.trim(token), "[ €]", ""), _number)


def _number(t: Column) -> Column:
    both = t.contains(",") & t.contains(".")
    comma_last = F.length(F.substring_index(t, ",", -1)) < F.length(F.substring_index(t, ".", -1))
    plain = (
        F.when(t.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+$"), F.regexp_replace(t, r"\.", ""))
        .when(t.rlike(r"^[0-9]{1,3}(,[0-9]{3})+$"), F.regexp_replace(t, ",", ""))
        .when(both & comma_last, F.regexp_replace(F.regexp_replace(t, r"\.", ""), ",", "."))
        .when(both, F.regexp_replace(t, ",", ""))
        .otherwise(F.regexp_replace(t, ",", "."))
    )
    return plain.try_cast("double")


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, value) of the first rule whose first group matches; null if none does."""
    hits = F.array(*[F.struct(F.lit(name).alias("rule"), F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).alias("value")) for name, pattern in rules])
    return F.get(F.filter(hits, lambda h: h["value"].isNotNull()), 0)


# Patterns of prices and areas in text, in order.
PRICE_RULES = [
    ("price_label", r"(?i)(?:çmimi|cmimi|price)[: ]*([0-9][0-9 .,]*)"),
    ("euro_after", r"(?i)([0-9][0-9 .,]*)[ ]*(?:€|eur|euro)"),
]
AREA_RULES = [
    ("area_label", r"(?i)(?:siperfaqe|sipërfaqe|siperfaqja)[: ]*([0-9]+(?:[.,][0-9]+)?)[ ]*m"),
    ("square_sign", r"([0-9]+(?:[.,][0-9]+)?)[ ]*m(?:²|2)"),
]


def price(text: Column) -> Column:
    """The total price that a text states; prices a square metre are no totals."""
    return number(F.regexp_replace(first_match(F.regexp_replace(text, RATE, ""), PRICE_RULES)["value"], r"[ .,]+$", ""))


def area(text: Column) -> Column:
    return F.regexp_replace(first_match(text, AREA_RULES)["value"], ",", ".").try_cast("double")


#: A price a square metre as a text states it.
RATE = r"(?i)([0-9]+(?:[.,][0-9]+)*)[ ]*(?:€|eur|euro)[ ]*(?:/|per)[ ]*m(?:2|²)"


def rate(text: Column) -> Column:
    return number(F.regexp_replace(F.nullif(F.regexp_extract(text, RATE, 1), F.lit("")), r"[ .,]+$", ""))


# Markers of property types, the first that occurs deciding.
MARKERS = (
    ("COMMERCIAL", ("lokal", "zyre", "dyqan")),
    ("LAND", ("truall", "toke", "parcel")),
    ("STUDIO", ("garsonier", "garsoniere", "studio")),
    ("APARTMENT", ("banes", "banese", "banesa", "apartament", "penthouse")),
    ("VILLA", ("vila", "villa")),
    ("HOUSE", ("shtepi", "shtepia", "shpi", "shpia")),
)


def property_type(title: Column, description: Column, default: str = "APARTMENT") -> Column:
    """The title's markers, then the description's, then the default."""

    def of(text: Column) -> Column:
        folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), "ëç", "ec")
        out = F.lit(None).cast("string")
        for name, marks in reversed(MARKERS):
            out = F.when(folded.rlike("|".join(marks)), name).otherwise(out)
        return out

    return F.coalesce(of(title), of(description), F.lit(default))


def content_hash(payload: Column, html: Column | None = None) -> Column:
    return F.sha2(F.concat(F.coalesce(payload, F.lit("")), F.coalesce(html, F.lit("")) if html is not None else F.lit("")), 256)


def without_tags(html: Column) -> Column:
    """Text of a page: tags out, the five common entities read, white space collapsed."""
    out = F.regexp_replace(html, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapsed(out)


def links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1)))


def safe_url(url: Column) -> Column:
    """The address if it is http(s) with a host and no credentials, else null."""
    return F.when(url.rlike(r"^https?://[A-Za-z0-9.-]+(:[0-9]+)?(/|$)"), url)
