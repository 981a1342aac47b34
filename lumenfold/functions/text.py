"""Text functions as column expressions: they stay in the JVM and in generated code."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions import constants as C

Text = Column | str
#: A letter, digit or underscore of any script.
WORD_SIGN = r"[\p{L}\p{N}_]"


def _col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_filled(*columns: Text) -> Column:
    """The first that is neither null nor empty, else the empty text."""
    return F.coalesce(*(F.nullif(_col(c), F.lit("")) for c in columns), F.lit(""))


def is_filler(word: Text, fillers: Iterable[str] = C.FILLERS) -> Column:
    """Whether a word, lower-cased and without outer punctuation, is on the list."""
    return F.lower(F.btrim(_col(word), F.lit(",.!?;:'\""))).isin(*fillers)


def bleep(text: Text, mode: str = "default", custom: Iterable[str] = ()) -> Column:
    """Listed words masked but for their first letter; ``mode`` is off, default or custom.

    The list is fixed when the plan is made and a mask's length is its word's, so each word is one replacement.
    """
    if mode not in ("off", "default", "custom"):
        raise ValueError(f"unknown profanity filter mode: {mode!r}")
    words = {"off": (), "default": C.PROFANITY}.get(mode, [w.lower() for w in custom if w.strip()])
    out = _col(text)
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        if len(word) > 1:
            head, rest = re.escape(word[0]), re.escape(word[1:])
            out = F.regexp_replace(out, rf"(?iu)(?<!{WORD_SIGN})({head}){rest}(?!{WORD_SIGN})", "$1" + "*" * (len(word) - 1))
    return out


def _whole(word: str) -> str:
    """A pattern of a word between word boundaries of any script."""
    sides = (("(?<!", "(?<=", word[0]), ("(?!", "(?=", word[-1]))
    first, last = ((no if re.match(r"\w", sign) else yes) + WORD_SIGN + ")" for no, yes, sign in sides)
    return first + re.escape(word) + last


def _in_case_of(found: Column, value: Column) -> Column:
    upper, lower = F.upper(found), F.lower(found)
    rest = F.substr(found, F.lit(2))
    title = (F.left(found, F.lit(1)) != F.left(lower, F.lit(1))) & (rest == F.lower(rest)) & (rest != F.upper(rest))
    titled = F.concat(F.upper(F.left(value, F.lit(1))), F.lower(F.substr(value, F.lit(2))))
    return F.when((found == upper) & (found != lower), F.upper(value)).when(title, titled).when((found == lower) & (found != upper), F.lower(value)).otherwise(value)


def replace_vocabulary(text: Text, vocabulary: Mapping[str, str]) -> Column:
    """Keys, longest first and whole words only, by their values in the case of what they replace.

    Upper, title and lower case carry over; other words get the value as written. One pass: a value isn't
    looked up again, since the text is cut at the keys and put together with their values between.
    """
    keys = sorted((k for k in vocabulary if k), key=len, reverse=True)
    if not keys:
        return _col(text)
    pattern = F.lit("(?iu)(?:" + "|".join(map(_whole, keys)) + ")")
    values = F.create_map(*(F.lit(x) for k, v in {k.lower(): v for k, v in vocabulary.items() if k}.items() for x in (k, v)))
    found = F.transform(F.regexp_extract_all(_col(text), pattern, F.lit(0)), lambda m: _in_case_of(m, F.coalesce(F.try_element_at(values, F.lower(m)), m)))
    pieces = F.split(_col(text), pattern, -1)
    return F.array_join(F.zip_with(pieces, found, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")


def slug(text: Text, fallback: str = "video") -> Column:
    """Letters, digits, _ and - of any script; runs of others become _, ends trimmed, 80 at most."""
    made = F.left(F.btrim(F.regexp_replace(_col(text), r"[^\p{L}\p{N}_\-]", "_"), F.lit("_")), F.lit(80))
    return F.coalesce(F.nullif(made, F.lit("")), F.lit(fallback))


def file_title(text: Text, default: str = "chapter") -> Column:
    """A title as a file name part."""
    made = F.btrim(F.regexp_replace(_col(text), r"[^\p{L}\p{N}_\-. ]", "_"))
    return F.coalesce(F.nullif(made, F.lit("")), F.lit(default))


def output_name(index: Text, title: Text) -> Column:
    return F.concat(F.lpad(_col(index).cast("string"), 2, "0"), F.lit("_"), file_title(title))


def title_of(text: Text) -> Column:
    """The first sentence with text, 80 characters at most; without one, the text's own first 80."""
    sentences = F.filter(F.transform(F.split(_col(text), "[.!?]"), lambda x: F.trim(x)), lambda s: s != "")
    return F.left(F.coalesce(F.try_element_at(sentences, F.lit(1)), _col(text)), F.lit(80))


def summary_of(text: Text) -> Column:
    return F.left(_col(text), F.lit(200))


def hook_score(first_words: Text) -> Column:
    """0.33 for each of: a question mark, an opening from the list, a number."""
    lowered = F.lower(_col(first_words))
    return sum((F.when(lowered.rlike(p), 0.33).otherwise(0.0) for p in C.HOOKS), F.lit(0.0))


def trend_hits(text: Text, trends: Iterable[str] = C.TRENDS) -> Column:
    """How many of the phrases the lower-cased text holds, also inside words."""
    listed = F.array(*map(F.lit, trends))
    # The text is lower-cased once, and not for each phrase.
    return F.transform(F.array(F.lower(_col(text))), lambda lowered: F.size(F.filter(listed, lambda t: F.contains(lowered, t))))[0]


def trend_score(text: Text, trends: Iterable[str] = C.TRENDS) -> Column:
    trends = list(trends)
    return F.least(F.lit(1.0), trend_hits(text, trends) / F.lit(max(len(trends) * 0.1, 1)))


def noun_phrases(text: Text) -> Column:
    """The first three runs of capitalised words, lower-cased."""
    found = F.regexp_extract_all(_col(text), F.lit(C.NOUN_PHRASE), F.lit(0))
    return F.slice(F.transform(found, F.lower), 1, 3)


def grade(score: Text) -> Column:
    s, out = _col(score), None
    for least, name in C.GRADES:
        out = F.when(s >= least, name) if out is None else out.when(s >= least, name)
    return F.when(s.isNull(), "—").otherwise(out.otherwise("C+"))


def minutes_seconds(seconds: Text, padded: bool = False) -> Column:
    s = _col(seconds)
    return F.format_string("%02d:%02d" if padded else "%d:%02d", F.floor(s / 60).cast("bigint"), F.floor(s % 60).cast("bigint"))


def hours_minutes_seconds(seconds: Text) -> Column:
    """h:mm:ss; null, NaN and 0 give 0:00:00."""
    s = F.coalesce(F.nanvl(_col(seconds).cast("double"), F.lit(0.0)), F.lit(0.0))
    parts = (F.floor(s / 3600), F.floor((s % 3600) / 60), F.floor(s % 60))
    return F.format_string("%d:%02d:%02d", *(p.cast("bigint") for p in parts))


def vtt_time(seconds: Text) -> Column:
    """HH:MM:SS.mmm"""
    s = _col(seconds)
    whole = (F.floor(s / 3600).cast("bigint"), F.floor((s % 3600) / 60).cast("bigint"))
    return F.format_string("%02d:%02d:%06.3f", *whole, s - whole[0] * 3600 - whole[1] * 60)


def srt_time(seconds: Text) -> Column:
    return F.replace(vtt_time(seconds), F.lit("."), F.lit(","))


def youtube_id(url: Text) -> Column:
    return F.nullif(F.regexp_extract(_col(url), C.VIDEO_ID, 1), F.lit(""))


def host_matches(url: Text, *hosts: str) -> Column:
    """Whether the URL's host is one of these or below one; look-alike hosts don't match."""
    names = "|".join(h.replace(".", r"\.") for h in hosts)
    return _col(url).rlike(rf"^https?://(?:[^/]+\.)?(?:{names})(?:/|$)")


def platform(url: Text) -> Column:
    """The first platform whose hosts match, else null."""
    out = None
    for name, hosts in C.HOSTS.items():
        test = host_matches(url, *hosts)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def source_kind(url: Text) -> Column:
    """Platform, ``upload`` for internal uploads, or ``unsupported``."""
    return F.when(_col(url).startswith("upload://"), "upload").otherwise(F.coalesce(platform(url), F.lit("unsupported")))


def is_short_form(url: Text) -> Column:
    kind = source_kind(url)
    shorts = _col(url).rlike(C.SHORTS)
    return F.coalesce(kind.isin("tiktok", "instagram") | ((kind == "youtube") & shorts), F.lit(False))


def is_supported(url: Text) -> Column:
    return F.coalesce(_col(url).startswith("upload://") | platform(url).isNotNull(), F.lit(False))


def truncate(text: Text, most: int = 80) -> Column:
    """Longer texts end in an ellipsis, without blanks before it."""
    t = _col(text)
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.left(t, F.lit(most - 1))), F.lit("…"))).otherwise(t)


def parse_hashtags(text: Text) -> Column:
    """Split at commas and blanks; one leading # goes, empty tags too."""
    parts = F.transform(F.split(_col(text), r"[,\s]+"), lambda x: F.trim(F.regexp_replace(x, "^#", "")))
    return F.filter(parts, lambda x: x != "")


def split_list(text: Text) -> Column:
    """A comma-separated setting as trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(_col(text), ","), lambda x: F.trim(x)), lambda x: x != "")


def score_weights(text: Text) -> Column:
    """Weights of the score from a setting's JSON; null if it isn't an object of numbers."""
    return F.from_json(_col(text), "map<string,double>")


def vocabulary_add(vocabulary: Text, key: Text, value: Text) -> Column:
    """The vocabulary with an entry more, or another value for its key; blank keys and values change nothing."""
    k, v = F.trim(_col(key)), F.trim(_col(value))
    kept = F.map_filter(_col(vocabulary), lambda x, _: x != k)
    return F.when((k != "") & (v != ""), F.map_concat(kept, F.create_map(k, v))).otherwise(_col(vocabulary))


def vocabulary_remove(vocabulary: Text, key: Text) -> Column:
    return F.map_filter(_col(vocabulary), lambda x, _: x != _col(key))


def capability(name: Text) -> Column:
    """What a workspace's tier says of a capability, as text (limits: null, without bound); unknown names are an error."""
    n = _col(name)
    known = F.when(n.isin(*C.CAPABILITIES), "true").when(n == "tier", C.TIER).when(n.isin(*C.LIMITS), F.lit(None).cast("string"))
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown capability: "), F.coalesce(n, F.lit("null")))).cast("string"))


def is_capability(name: Text) -> Column:
    return F.coalesce(_col(name).isin(*C.CAPABILITIES, *C.LIMITS, "tier"), F.lit(False))


def mode_options(mode: Text, short: Text, chosen: Mapping[str, Column]) -> Column:
    """The options of a mode: all on, all but the proposer by chapters, else what was chosen.

    What wasn't chosen is off, but for short videos, whose render option is on.
    """

    def value(option: str) -> Column:
        default = F.coalesce(_col(short), F.lit(False)) if option in C.SHORT_FORM_ON else F.lit(False)
        own = F.coalesce(chosen[option], default) if option in chosen else default
        return F.when(_col(mode) == "auto", F.lit(True)).when(_col(mode) == "chapter", F.lit(option not in C.CHAPTER_MODE_OFF)).otherwise(own)

    return F.struct(*(value(o).alias(o) for o in C.OPTIONS))


def external_caps(title: Text, description: Text, tags: Text) -> Column:
    """What the publishing interface takes at most: 100 and 5,000 characters, 30 tags."""
    return F.struct(F.left(_col(title), F.lit(100)).alias("title"), F.left(_col(description), F.lit(5000)).alias("description"), F.slice(_col(tags), 1, 30).alias("tags"))


def backoff_ms(attempt: Text) -> Column:
    return F.least(1000 * F.pow(F.lit(2.0), _col(attempt)), F.lit(30000.0)).cast("bigint")


def cache_key(query: Text, count: Text) -> Column:
    """The key of a cached search."""
    asked = F.lower(F.btrim(_col(query), F.lit(" \t\n\r\x0b\x0c")))
    return F.left(F.sha1(F.concat_ws("|", asked, _col(count).cast("string"))), F.lit(16))


def transcript_text(transcript: Text, summary: Text, title: Text) -> Column:
    """Plain text of a stored transcript in any of its shapes, else the summary, else the title, else empty.

    Shapes, as JSON: a plain string, {text}, {segments: [{text}]} or {words: [{word}]}.
    """
    t = _col(transcript)
    rows = F.from_json(F.get_json_object(t, "$.segments"), "array<struct<text:string>>")
    words = F.from_json(F.get_json_object(t, "$.words"), "array<struct<word:string>>")
    plain = F.when(~F.coalesce(F.trim(t).startswith("{"), F.lit(False)), t)
    joined = (F.trim(F.array_join(F.transform(F.filter(a, lambda x: x[f].isNotNull()), lambda x: x[f]), " ")) for a, f in ((rows, "text"), (words, "word")))
    return first_filled(plain, F.get_json_object(t, "$.text"), *joined, summary, title)


def preset(style: Text) -> Column:
    """A caption style as struct(font_size, color, highlight, error); an unknown one has an error only."""
    fields = ("font_size", "color", "highlight")

    def value(i: int) -> Column:
        out = None
        for name, values in C.PRESETS.items():
            out = F.when(_col(style) == name, F.lit(values[i])) if out is None else out.when(_col(style) == name, F.lit(values[i]))
        return out

    listed = ", ".join(sorted(C.PRESETS))
    error = F.when(~F.coalesce(_col(style).isin(*C.PRESETS), F.lit(False)), F.concat(F.lit("unknown caption style: "), F.coalesce(_col(style), F.lit("null")), F.lit(f"; must be one of {listed}")))
    return F.struct(*(value(i).alias(f) for i, f in enumerate(fields)), error.alias("error"))


def length_range(name: Text) -> Column:
    """A named length range as struct(low, high) in seconds; null for other names."""
    out = None
    for key, (low, high) in C.LENGTH_RANGES.items():
        value = F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"))
        out = F.when(_col(name) == key, value) if out is None else out.when(_col(name) == key, value)
    return out


def valid_range(start: Text, end: Text) -> Column:
    return (_col(start) >= 0) & (_col(start) < _col(end))


def or_default(value: Text, default: str) -> Column:
    """Null and empty both read as the default."""
    return F.coalesce(F.nullif(_col(value), F.lit("")), F.lit(default))
