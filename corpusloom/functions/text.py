"""Column functions over strings, dates, numbers, arrays and maps. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token patterns: of topic corpora, and of stemmed article corpora (no digits).
WORDS, ARTICLE_WORDS = r"[$a-zA-Z0-9]+", r"[$a-zA-Z_]+"


def words(text: Column, pattern: str = WORDS) -> Column:
    """All matches of a token pattern, in order; null text: none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def is_token(raw: Column, least: int = 2, most: int | None = None) -> Column:
    """Whether a raw match is kept: its length is within bounds and it has a letter."""
    ok = (F.length(raw) >= least) & raw.rlike("[A-Za-z]")
    return ok if most is None else ok & (F.length(raw) <= most)


def line(text: Column, number: int) -> Column:
    """The line of that number, from 1, or null."""
    return F.get(F.split(text, "\n"), F.lit(number - 1))


def one_line(text: Column) -> Column:
    """Lines joined by one blank, without a blank at the end."""
    return F.regexp_replace(F.regexp_replace(text, r"\r?\n", " "), " $", "")


def strip_dateline(text: Column) -> Column:
    """Text after the first hyphen if that is among characters 2 to 30, else the text."""
    at = F.instr(text, "-")
    return F.when(at.between(2, 30), F.substring(text, at + 1, F.length(text))).otherwise(text)


def before_marker(text: Column, *markers: str) -> Column:
    """Text before the first of the markers that occurs at all; the order of the markers decides, not their place."""
    at = F.coalesce(*(F.nullif(F.instr(text, m), F.lit(0)) for m in markers))
    return F.when(at.isNull(), text).otherwise(F.substring(text, F.lit(1), at - 1))


def between_tags(text: Column, tag: str) -> Column:
    """Contents of all pairs of a tag, in order."""
    return F.regexp_extract_all(text, F.lit(f"(?s)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))


def pieces(text: Column, separator_pattern: str) -> Column:
    """Non-empty pieces between separators."""
    return F.filter(F.split(text, separator_pattern), lambda p: p != "")


def encloses(long: Column, short: Column) -> Column:
    """Whether each word of `short` starts `long` as a whole word, or starts a later word of it."""
    blank = F.lit(" ")
    return F.forall(F.split(short, " "), lambda t: F.startswith(long, F.concat(t, blank)) | (F.position(F.concat(blank, t), long) > 1))


def join_parts(delimiter: str, *parts: Column) -> Column:
    """Non-empty parts joined, trimmed."""
    return F.trim(F.concat_ws(delimiter, *(F.nullif(p, F.lit("")) for p in parts)))


def or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def phone(number: Column) -> Column:
    """A number without hyphens."""
    return F.translate(number, "-", "")


def star_list(value: Column) -> Column:
    """`[a*b*]` as an array, and nulls as null."""
    return F.filter(F.split(F.substring(value, F.lit(2), F.length(value) - 2), r"\*"), lambda x: x != "")


def to_star_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: F.concat(x, F.lit("*"))), ""), F.lit("]"))


def comma_tags(value: Column) -> Column:
    """A comma list as trimmed tags."""
    return F.transform(F.split(value, ","), lambda t: F.trim(t))


def comma_list(values: Column) -> Column:
    """`a,b,`: each value and a comma."""
    return F.array_join(F.transform(values, lambda v: F.concat(v, F.lit(","))), "")


def file_name(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def with_scheme(url: Column, scheme: str = "http://") -> Column:
    return F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.concat(F.lit(scheme), url))


def clean_text(text: Column) -> Column:
    """Comment blocks gone, typographic apostrophes as ASCII ones, white space as single blanks."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), "&#8217;|’", "'")
    return F.trim(F.regexp_replace(plain, r"[ \t\r\n]+", " "))


def plain_text(html: Column) -> Column:
    """Text of an HTML fragment: scripts, styles and comments without content, tags as blanks."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return clean_text(F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " "))


def first_word(value: Column) -> Column:
    return F.lower(F.substring_index(value, " ", 1))


def after_hyphen(value: Column) -> Column:
    at = F.instr(value, "-")
    return F.substring(value, at + 1, F.length(value))


#: Initial consonants of Korean syllables that open a section, and their first syllables.
KOREAN_SECTIONS = (("ㄱ", "가"), ("ㄴ", "나"), ("ㄷ", "다"), ("ㄹ", "라"), ("ㅁ", "마"), ("ㅂ", "바"), ("ㅅ", "사"), ("ㅇ", "아"), ("ㅈ", "자"), ("ㅊ", "차"), ("ㅋ", "카"), ("ㅌ", "타"), ("ㅍ", "파"), ("ㅎ", "하"))
#: Code points of syllables that count as Korean.
HANGUL = (44032, 52203)


def name_section(name: Column) -> Column:
    """Section of a name list: a Korean initial, a letter A to Z, or #."""
    first = F.upper(F.substring(name, 1, 1))
    code = F.ascii(first)
    section = F.when(code.between(65, 90) & (F.length(first) == 1), first)  # ß becomes SS, which is no letter
    for sign, syllable in reversed(KOREAN_SECTIONS):
        section = section.when(code.between(max(ord(syllable), HANGUL[0]), HANGUL[1]), F.lit(sign))
    return F.when(F.coalesce(F.length(name), F.lit(0)) == 0, "#").otherwise(section.otherwise("#"))


def section_order(section: Column) -> Column:
    """Korean sections first, then letters, then #."""
    return F.when(section == "#", 2).when(F.ascii(section) > 127, 0).otherwise(1)


def minutes(seconds: Column) -> Column:
    return seconds / F.lit(60.0)


def percent_of(percent: int, total: Column) -> Column:
    """percent * total / 100 in whole numbers."""
    return F.floor(F.lit(percent) * total / 100)


def friend_weight(minutes_: Column, calls: Column) -> Column:
    """Strength of a friendship: 0.3 of the minutes and 0.7 of the calls, of 220."""
    return (F.lit(0.3) * minutes_ + F.lit(0.7) * calls) / F.lit(220.0)


def z_score(count: Column, size: Column, corpus_count: Column, corpus_size: Column) -> Column:
    """How far a word's count in `size` words is from what its share of the corpus suggests, in standard deviations."""
    p = corpus_count / corpus_size
    return (count - size * p) / F.sqrt(size * p * (1 - p))


def is_permutation(values: Column) -> Column:
    """Whether an array holds each of 0 to n-1 once."""
    return F.array_sort(values) == F.sequence(F.lit(0), F.size(values) - 1).cast("array<int>")


def swapped(values: Column, seed: int, swaps: int = 300) -> Column:
    """An array shuffled by so many swaps of two places, which the md5 of the seed, the swap's number, the side and the array's length picks."""
    hashed = lambda i, side: F.md5(F.concat_ws(":", F.lit(str(seed)), i.cast("string"), F.lit(str(side)), F.size(values).cast("string")))
    place = lambda i, side: F.pmod(F.conv(F.substring(hashed(i, side), 1, 12), 16, 10).cast("long"), F.size(values)).cast("int")

    def swap(now: Column, i: Column) -> Column:
        a, b = place(i, 0), place(i, 1)
        return F.transform(now, lambda x, k: F.when(k == a, F.get(now, b)).when(k == b, F.get(now, a)).otherwise(x))

    return F.aggregate(F.sequence(F.lit(1), F.lit(swaps)), values, swap)


def expanded(ids: Column, counts: Column) -> Column:
    """Each id as many times as its count says."""
    return F.flatten(F.zip_with(ids, counts, lambda i, n: F.array_repeat(i, n)))


def same_elements(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def pair_map(value: Column) -> Column:
    """`k,v,k,v` as a map of whole numbers; the last of equal keys counts."""
    parts = F.filter(F.split(value, ","), lambda x: x != "")
    n = F.floor(F.size(parts) / 2).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    entries = F.transform(at, lambda i: F.struct(F.get(parts, i * 2).alias("key"), F.get(parts, i * 2 + 1).try_cast("int").alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def map_pairs(value: Column) -> Column:
    """A map as `k,v,k,v`, keys ascending."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(value)), lambda e: F.concat(e["key"], F.lit(","), e["value"].cast("string"))), ",")


def increment(counts: Column, key: Column | str) -> Column:
    """A map with the key's count one higher; missing keys start from 0."""
    key = F.lit(key) if isinstance(key, str) else key
    rest = F.map_filter(counts, lambda k, v: k != key)
    return F.map_concat(rest, F.map_from_arrays(F.array(key), F.array(F.coalesce(F.element_at(counts, key), F.lit(0)) + 1)))


def draw_index(weights: Column, u: Column, size: int | None = None) -> Column:
    """Inverse-CDF draw: the least index whose running sum exceeds u times the total. size: the arrays' length, where it is known and small."""
    if size is not None:
        sums = [F.get(weights, F.lit(0))]
        for k in range(1, size):
            sums.append(sums[-1] + F.get(weights, F.lit(k)))
        drawn = F.when(u * sums[-1] < sums[0], F.lit(0))
        for k, s in enumerate(sums[1:-1], 1):
            drawn = drawn.when(u * sums[-1] < s, F.lit(k))
        return drawn.otherwise(F.lit(size - 1))
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(-1).alias("found"))
    step = lambda a, w: F.struct(
        (a["sum"] + w).alias("sum"), (a["i"] + 1).alias("i"), F.when((a["found"] < 0) & (u * total < a["sum"] + w), a["i"]).otherwise(a["found"]).alias("found")
    )
    return F.aggregate(weights, start, step, lambda a: F.when(a["found"] < 0, a["i"] - 1).otherwise(a["found"]))


#: Timestamp pattern of log lines.
LOG_TIME = "yyyyMMddHHmmssZ"


def from_millis(value: Column) -> Column:
    return F.timestamp_millis(value.cast("long"))


def log_time(utc: Column, zone: str) -> Column:
    """A time without a zone, in UTC, as a log line's text in the pattern LOG_TIME in some zone, whatever the session's own is."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc.cast("timestamp_ntz"))
    minutes = F.timestamp_diff("MINUTE", utc.cast("timestamp_ntz"), local).cast("int")
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(F.date_format(local, LOG_TIME.removesuffix("Z")), F.when(minutes < 0, "-").otherwise("+"), two(F.abs(minutes) / 60), two(F.abs(minutes) % 60))


def inserted(ordered: Column, value: Column) -> Column:
    """An ascending array with one more value, after those equal to it: one pass, no sort. A null value leaves the array as it is."""
    return F.when(value.isNull(), ordered).otherwise(F.concat(F.filter(ordered, lambda x: x <= value), F.array(value), F.filter(ordered, lambda x: x > value)))


def xml_text(value: Column) -> Column:
    """An XML element's content with the reserved characters escaped; null: empty."""
    out = F.coalesce(value, F.lit(""))
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def xml_element(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), xml_text(value), F.lit(f"</{name}>"))


def url_parameter(name: str, value: Column) -> Column:
    """`name=value` with the value encoded for a URL."""
    return F.concat(F.lit(name + "="), F.url_encode(value))


#: Question numbers of a test sheet, and the first number of each kind of question.
QUESTIONS = (*range(1, 17), *range(28, 39))
QUESTION_KINDS = ((28, "antonym"), (8, "analogy"), (1, "completion"))


def questions(sheet: Column) -> Column:
    """A test sheet as an array of (number, kind, text): cut before each `n.` in turn, each looked for after the last cut; numbers that don't come are passed over."""
    kind = lambda n: next(k for first, k in QUESTION_KINDS if n >= first)
    markers = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(f"{n}.").alias("mark"), F.lit(kind(n)).alias("kind")) for n in QUESTIONS[1:]))
    piece = lambda n, k, text: F.struct(n.alias("number"), k.alias("kind"), text.alias("text"))
    none = F.array().cast("array<struct<number:int,kind:string,text:string>>")
    start = F.struct(sheet.alias("rest"), F.lit(1).alias("n"), F.lit("completion").alias("kind"), none.alias("done"))

    def cut(state: Column, m: Column) -> Column:
        at = F.position(m["mark"], state["rest"])
        found = F.struct(
            F.substring(state["rest"], at, F.length(state["rest"])).alias("rest"), m["n"].alias("n"), m["kind"].alias("kind"),
            F.array_append(state["done"], piece(state["n"], state["kind"], F.substring(state["rest"], F.lit(1), at - 1))).alias("done"),
        )
        return F.when(at > 0, found).otherwise(state)

    return F.aggregate(markers, start, cut, lambda s: F.array_append(s["done"], piece(s["n"], s["kind"], s["rest"])))
