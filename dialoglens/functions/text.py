"""Text clean-up as column expressions over whole frames."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: patterns and spellings that decide what a product name becomes
PRODUCT_JUNK = (
    r"(?i)^(?:quantity\s*:\s*\d+.*|n/?a|none|:|price(?:\s*:.*)?|name(?:\s*:.*)?"
    r"|model(?:\s*:.*)?|color(?:\s*:.*)?)$"
)
HEBREW_IPHONE = r"איי?פ{1,2}ו?ן"
MISHEARD_IPHONE = r"(?i)iphone\s*(?:7|12)(?!\d)"
IPHONE = "iphone"
INTENDED_IPHONE = "iphone 17"

# fixed values: fields an action item may keep its text in, best first
ACTION_FIELDS = ["action", "description", "name", "instructions", "task", "item", "text"]

# fixed values: sentiment words
SENTIMENT_WORDS = {
    "חיובי": 4,
    "positive": 4,
    "שלילי": 2,
    "negative": 2,
    "נייטרלי": 3,
    "neutral": 3,
    "מעורב": 3,
    "mixed": 3,
}
POSITIVE_WORDS = ["חיובי", "positive"]
NEGATIVE_WORDS = ["שלילי", "negative"]
NEUTRAL = 3

# fixed values: spellings of the keys in a model response
KEY_ALIASES = {
    "Summary": "summary",
    "Categories": "categories",
    "Category": "categories",
    "category": "categories",
    "Sentiment": "sentiment",
    "Products": "products",
    "Customer_satisfaction": "customer_satisfaction",
    "Unresolved_issues": "unresolved_issues",
    "Action_items": "action_items",
    "ActionItems": "action_items",
    "סיכום": "summary",
    "סיכום השיחה": "summary",
    "קטגוריות": "categories",
    "קטגוריה": "categories",
    "רגש": "sentiment",
    "רגשות": "sentiment",
    "מוצרים": "products",
    "שביעות רצון": "customer_satisfaction",
    "שביעות_רצון": "customer_satisfaction",
    "בעיות פתוחות": "unresolved_issues",
    "בעיות שלא נפתרו": "unresolved_issues",
    "פעולות המשך": "action_items",
    "פעולות_המשך": "action_items",
    "משימות": "action_items",
    "שם": "_name",
}

# fixed values: abbreviation endings the letter-quote-letter rule does not reach
ABBREVIATION_ENDING = "וכו[\"״]"
LETTER_QUOTE_LETTER = "([א-ת])[\"״]([א-ת])"
CONTROL_CHARACTERS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"

# fixed values: marker and length of shortened transcripts, share that makes a text Hebrew
SHORTENED_MARKER = "...[תחילת השיחה קוצרה]...\n"
TRANSCRIPT_CHARS = 20_000
HEBREW_SHARE = 0.3
SEVERE_TRUNCATION_CHARS = 100

STRUCTURE_CHARS = "[]{}\"'"


BLANKS = " \t\n\x0b\f\r"
#: Line ends that are no blanks; blanks before such a last one are trimmed as well.
OTHER_LINE_ENDS = ["\x85", "\u2028", "\u2029"]


def strip(text: Column) -> Column:
    """Trim every kind of blank, not only spaces."""
    return let(
        F.btrim(text, F.lit(BLANKS)),
        lambda t: F.when(F.substring(t, -1, 1).isin(OTHER_LINE_ENDS), F.regexp_replace(text, r"^\s+|\s+$", "")).otherwise(t),
    )


def not_blank(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit("")).isNotNull()


def pad_free(identifier: Column) -> Column:
    """Canonical form of ids that some tables store with trailing blanks."""
    return F.rtrim(identifier)


# ---- products --------------------------------------------------------------------------


def normalize_product(name: Column) -> Column:
    """Trimmed product name with known mistakes fixed; NULL for blanks and junk."""
    text = strip(name)
    fixed = F.regexp_replace(text, HEBREW_IPHONE, IPHONE)
    fixed = F.regexp_replace(fixed, MISHEARD_IPHONE, INTENDED_IPHONE)
    fixed = strip(F.regexp_replace(fixed, r"\s{2,}", " "))
    return F.when(~text.rlike(PRODUCT_JUNK), F.nullif(fixed, F.lit("")))


def split_csv(text: Column) -> Column:
    parts = F.transform(F.split(text, ","), lambda part: strip(part))
    return F.filter(parts, lambda part: part != "")


# ---- JSON kept in text columns ----------------------------------------------------------


def json_kind(value: Column) -> Column:
    """ARRAY, OBJECT, STRING, … of a variant; NULL stays NULL."""
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)


def unstructured(text: Column) -> Column:
    return F.translate(text, STRUCTURE_CHARS, "")


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


# text of the values other than strings that count as empty
EMPTY_VALUE = r"^(?:null|false|-?0(?:\.0*)?(?:[eE][+-]?\d+)?|\[\]|\{\})$"


def truthy(value: Column, text: Column | None = None) -> Column:
    """False for null, false, zero and empty values. `text` is the value's text, where it is at hand."""
    text = value.cast("string") if text is None else text
    empty = F.coalesce(text, F.lit("null")).rlike(EMPTY_VALUE)
    return F.when(F.schema_of_variant(value) == "STRING", text != "").otherwise(~empty)


def _spaced(raw: Column) -> Column:
    """Blank after each comma and colon outside quotes, as nested values are rendered."""
    outside = r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
    return F.regexp_replace(F.regexp_replace(raw, f",{outside}", ", "), f":{outside}", ": ")


def _rendered(raw: Column, value: Column) -> Column:
    nested = json_kind(value).isin("ARRAY", "OBJECT")
    return strip(unstructured(F.when(nested, _spaced(raw)).otherwise(raw)))


_STRICT = {"allowSingleQuotes": "false"}
#: What a JSON text may begin with, and more. Other texts aren't parsed: a failed parse costs many times a good one.
JSON_BEGINS = [*"[{\"tfn-0123456789NI+.'/#\ufeff"]


def _read_json(text: Column) -> Column:
    """The stripped text, its variant if it is JSON, and the kind of that."""
    source = strip(F.coalesce(text, F.lit("")))
    value = lambda t: F.when(F.substring(t, 1, 1).isin(JSON_BEGINS), F.try_parse_json(t))
    parsed = let(source, lambda t: F.struct(t.alias("text"), value(t).alias("value")))
    return let(parsed, lambda p: F.struct(p["text"], p["value"], json_kind(p["value"]).alias("kind")))


def _listed_items(source: Column, items: Column) -> Column:
    raw = F.from_json(source, "array<string>", _STRICT)
    return F.filter(
        F.zip_with(raw, items, lambda r, v: F.when(truthy(v), _rendered(r, v)).otherwise("")), lambda item: item != ""
    )


def _listed_fields(source: Column, fields: Column) -> Column:
    raw = F.map_entries(F.from_json(source, "map<string,string>", _STRICT))
    pairs = F.transform(
        raw,
        lambda e: let(
            F.element_at(fields, e["key"]),
            lambda v: F.when(truthy(v), F.concat(e["key"], F.lit(": "), _rendered(e["value"], v))).otherwise(""),
        ),
    )
    return F.filter(pairs, lambda pair: pair != "")


def json_to_csv(text: Column) -> Column:
    """JSON array or object, or plain text, as a comma-separated list.

    Empty items are dropped; booleans appear as `true`/`false`. Raw item texts come from
    `from_json`, which keeps the order of keys, their kinds from the variant.
    """
    return let(
        _read_json(text),
        lambda j: F.when(
            j["kind"] == "ARRAY", F.array_join(_listed_items(j["text"], j["value"].cast("array<variant>")), ", ")
        )
        .when(
            j["kind"] == "OBJECT", F.array_join(_listed_fields(j["text"], j["value"].cast("map<string,variant>")), ", ")
        )
        .otherwise(F.array_join(split_csv(unstructured(j["text"])), ", ")),
    )


def _field_text(item: Column) -> Column:
    fields = F.array(*[F.try_variant_get(item, f"$.{name}", "variant") for name in ACTION_FIELDS])
    texts = F.transform(F.filter(fields, lambda f: truthy(f)), lambda f: strip(f.cast("string")))
    return F.get(F.filter(texts, lambda t: ~F.lower(t).isin("", "none")), 0)


def _plain_item(item: Column) -> Column:
    filled = lambda text: F.when(text != "", text)
    return let(
        item.cast("string"), lambda text: F.when(truthy(item, text) & (F.lower(text) != "none"), let(strip(text), filled))
    )


def preview(name: str, chars: int | None) -> Column:
    """The first characters of a column under its name; None shows all."""
    return (F.col(name) if chars is None else F.substring(name, 1, chars)).alias(name)


def cut_at_item(text: Column, max_length: int | None) -> Column:
    """At most `max_length` characters, cut after the last whole item if half or more remains; None cuts nothing."""
    if max_length is None:
        return text

    def cut(head: Column) -> Column:
        tail_after_comma = F.instr(F.reverse(head), ",")
        comma_at = F.lit(max_length) - tail_after_comma
        whole = (tail_after_comma > 0) & (comma_at > max_length * 0.5)
        return F.regexp_replace(F.when(whole, F.substring(head, F.lit(1), comma_at)).otherwise(head), "[, ]+$", "")

    return let(
        text, lambda t: F.when(F.length(t) > max_length, let(F.substring(t, 1, max_length), cut)).otherwise(t)
    )


def action_items_text(text: Column, max_length: int | None = None) -> Column:
    """Only the wording of the action items, without their dates, owners and states."""
    head = lambda plain: plain if max_length is None else F.substring(plain, 1, max_length)
    is_object = lambda item: F.startswith(F.schema_of_variant(item), F.lit("OBJECT"))
    wording = lambda item: F.when(is_object(item), _field_text(item)).otherwise(_plain_item(item))

    def listed(value: Column) -> Column:
        items = F.transform(value.cast("array<variant>"), wording)
        return F.array_join(F.filter(items, lambda w: w.isNotNull()), ", ")

    return let(
        _read_json(text),
        lambda j: F.when(
            j["kind"].isin("ARRAY", "OBJECT"),
            cut_at_item(
                F.when(j["kind"] == "ARRAY", listed(j["value"])).otherwise(F.coalesce(_field_text(j["value"]), F.lit(""))),
                max_length,
            ),
        )
        .when(j["kind"].isNull(), strip(head(unstructured(j["text"]))))
        .otherwise(""),
    )


def coerce_list(value: Column, split: bool) -> Column:
    """Variant → list of texts: text becomes a list (split at commas, or one item), others empty."""
    none = F.array().cast("array<string>")

    def alone(text: Column) -> Column:
        return split_csv(text) if split else F.when(strip(text) != "", F.array(text)).otherwise(none)

    return let(
        F.struct(json_kind(value).alias("kind"), value.alias("value")),
        lambda v: F.when(
            v["kind"] == "ARRAY", F.transform(v["value"].cast("array<variant>"), lambda x: x.cast("string"))
        )
        .when(v["kind"] == "STRING", let(v["value"].cast("string"), alone))
        .otherwise(none),
    )


# ---- repair of model output ---------------------------------------------------------------


def strip_abbrev_quotes(text: Column) -> Column:
    """Hebrew abbreviations without the quote inside, which would end a JSON string."""
    ended = F.regexp_replace(text, ABBREVIATION_ENDING, "וכו")
    return F.regexp_replace(ended, LETTER_QUOTE_LETTER, "$1$2")


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_CHARACTERS, "")


def _count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def missing_braces(text: Column) -> Column:
    return _count_of(text, "{") - _count_of(text, "}")


def truncation_class(text: Column) -> Column:
    short = F.length(text) < SEVERE_TRUNCATION_CHARS
    return let(
        missing_braces(text),
        lambda gap: F.when(gap == 0, "complete").when(short, "severe").when(gap > 0, "repairable").otherwise("unbalanced"),
    )


def _commas_between_lines(text: Column) -> Column:
    return F.regexp_replace(text, r'(?<=["\]}])[ \t\r]*\n\s*(?="[^"\n]*"\s*:)', ",\n")


def _outer_object(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def _if_json(text: Column) -> Column:
    return let(text, lambda t: F.when(F.try_parse_json(t).isNotNull(), t))


def repair_json(text: Column) -> Column:
    """The first of several repairs that parses; NULL if none does."""

    def closed(clean: Column) -> Column:
        return F.concat(clean, F.repeat(F.lit("}"), F.greatest(missing_braces(clean), F.lit(0))))

    def repairs(whole: Column) -> Column:
        return F.coalesce(
            _if_json(whole), _if_json(_commas_between_lines(whole)), _if_json(_commas_between_lines(_outer_object(whole)))
        )

    clean = strip_control(strip_abbrev_quotes(strip(text)))
    one_line = F.regexp_replace(_outer_object(strip(text)), r"[\r\n]", " ")
    no_trailing = F.regexp_replace(one_line, r",(\s*[}\]])", "$1")
    return F.coalesce(
        let(let(clean, closed), repairs), _if_json(strip_control(strip_abbrev_quotes(no_trailing)))
    )


def canonical_key(key: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for pair in KEY_ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(aliases, key), F.lower(key))


def normalize_keys(fields: Column) -> Column:
    """Map with canonical keys; of keys that become equal the last one stays."""
    entries = F.transform(
        F.map_entries(fields),
        lambda e: F.struct(canonical_key(e["key"]).alias("key"), e["value"].alias("value")),
    )
    later_keys = lambda i: F.transform(F.slice(entries, i + 2, F.size(entries)), lambda e: e["key"])
    return F.map_from_entries(
        F.filter(entries, lambda e, i: ~F.array_contains(later_keys(i), e["key"]))
    )


# ---- scores and shares ----------------------------------------------------------------------


def script_share(text: Column, char_class: str) -> Column:
    """Share of the characters of `text` inside a regex character class."""
    inside = F.length(F.regexp_replace(text, f"[^{char_class}]", ""))
    return F.coalesce(inside / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def is_hebrew(text: Column) -> Column:
    return script_share(text, r"\u0590-\u05FF") > HEBREW_SHARE


def _one_to_five(number: Column) -> Column:
    """Whole part between 1 and 5; NULL stays NULL (`least` alone would skip it)."""
    whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
    return F.when(number.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), whole)).cast("int"))


def _number(text: Column) -> Column:
    """Text as a number; only what looks like one is cast, as failed casts are slow."""
    return F.when(text.rlike(r"^[+-]?\d+(?:\.\d+)?$"), text.try_cast("double"))


def sentiment_to_int(text: Column) -> Column:
    """Word or number → 1–5; 3 for anything else."""
    words = F.create_map(*[F.lit(x) for pair in SENTIMENT_WORDS.items() for x in pair])
    score = lambda word: F.coalesce(F.element_at(words, word), _one_to_five(_number(word)), F.lit(NEUTRAL))
    return let(F.lower(strip(text)), score)


def satisfaction_to_int(text: Column) -> Column:
    """Whole number in text → 1–5; 3 for anything else."""
    return F.coalesce(_one_to_five(strip(text).try_cast("int")), F.lit(NEUTRAL))


def number_or_text_score(value: Column, from_text) -> Column:
    """Variant form of the two functions above: numbers are clamped, texts go through `from_text`."""
    parts = F.struct(json_kind(value).alias("kind"), value.cast("string").alias("text"))
    return let(
        parts,
        lambda v: F.when(v["kind"].isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), _one_to_five(v["text"].try_cast("double")))
        .when(v["kind"] == "STRING", from_text(v["text"]))
        .otherwise(NEUTRAL),
    )


def sentiment_word_to_int(text: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in SENTIMENT_WORDS.items() for x in pair])
    return F.coalesce(F.element_at(words, F.lower(strip(text))), F.lit(NEUTRAL))


def mentions(text: Column, words: list[str]) -> Column:
    """True where the lower-cased text contains one of the words; false on NULL."""
    found = F.lit(False)
    for word in words:
        found = found | F.lower(text).contains(word)
    return F.coalesce(found, F.lit(False))


def tail_truncate(text: Column, max_chars: int = TRANSCRIPT_CHARS) -> Column:
    """The end of a long transcript, where the outcome is, behind a marker."""
    return F.when(F.length(text) > max_chars, F.concat(F.lit(SHORTENED_MARKER), F.right(text, F.lit(max_chars)))).otherwise(text)


def speaker_label(owner: Column) -> Column:
    return (
        F.when(owner == "A", "Agent").when(owner == "C", "Customer").otherwise(F.coalesce(owner, F.lit("Unknown")))
    )


def speaker_class(owner: Column) -> Column:
    return F.when(owner == "A", "agent").when(owner == "C", "customer").otherwise("other")
