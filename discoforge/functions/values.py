"""Column builders for numbers, durations, dates, flags and bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITE, basename, blank, clean, col, stem, trimmed

_FLOAT = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def leading_int(c: Column | str) -> Column:
    """F02. The whole number that a text starts with, after white space; null if none."""
    return F.regexp_extract(col(c).cast("string"), rf"^[{WHITE}]*([+-]?\d+)", 1).try_cast("bigint")


def nonzero_int(c: Column | str) -> Column:
    """F03. leading_int, with null for zero."""
    return F.nullif(leading_int(c), F.lit(0).cast("bigint"))


def leading_float(c: Column | str) -> Column:
    """F04. The number that a text starts with, after white space; null if none."""
    return F.regexp_extract(col(c).cast("string"), rf"^[{WHITE}]*({_FLOAT})", 1).try_cast("double")


def bound(x: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint")


_ISO = r"(?i)^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?$"


def _iso_part(s: Column, group: int, pattern: str = _ISO) -> Column:
    return F.coalesce(F.regexp_extract(s, pattern, group).try_cast("double"), F.lit(0.0))


def _clock(s: Column) -> tuple[Column, Column]:
    """Parts between colons as numbers; whether all are."""
    parts = F.transform(F.split(s, ":"), lambda x: leading_float(x))
    return parts, F.forall(parts, lambda x: x.isNotNull())


def _seconds(s: Column) -> Column:
    parts, numbers = _clock(s)
    p = lambda i: F.get(parts, F.lit(i))
    return (
        F.when(s.rlike(r"^\d+(\.\d+)?$"), _half_up(s.try_cast("double")))
        .when(s.rlike(_ISO), _half_up(_iso_part(s, 1) * 3600 + _iso_part(s, 2) * 60 + _iso_part(s, 3)))
        .when(numbers & (F.size(parts) == 3), _half_up(p(0) * 3600 + p(1) * 60 + p(2)))
        .when(numbers & (F.size(parts) == 2), _half_up(p(0) * 60 + p(1)))
    )


def seconds(c: Column | str) -> Column:
    """F13. Whole seconds of '270', 'PT4M30S', '04:30' or '00:04:30'; null for anything else."""
    return bound(trimmed(col(c).cast("string")), _seconds)


def seconds_of_time_field(c: Column | str, minutes_as_hours: bool = True) -> Column:
    """F14. seconds; h:mm:00 of over an hour is read as minutes and seconds, which a time field took for hours."""

    def of(s: Column) -> Column:
        parts, numbers = _clock(s)
        p = lambda i: F.get(parts, F.lit(i))
        mistaken = numbers & (F.size(parts) == 3) & (p(2) == 0) & (p(0) > 0) & (p(0) * 3600 + p(1) * 60 > 3600)
        return F.when(~s.rlike(_ISO) & mistaken, _half_up(p(0) * 60 + p(1))).otherwise(_seconds(s))

    return bound(trimmed(col(c).cast("string")), of) if minutes_as_hours else seconds(c)


def sheet_seconds(c: Column | str) -> Column:
    """F15. Seconds of '3:45' or h:m:s, else the leading number unless zero; not rounded."""
    s = trimmed(col(c).cast("string"))
    parts = F.transform(F.split(s, ":"), lambda x: F.when(trimmed(x) == "", F.lit(0.0)).otherwise(trimmed(x).try_cast("double")))
    p = lambda i: F.get(parts, F.lit(i))
    return F.when(s.contains(":"), F.when(F.size(parts) == 3, p(0) * 3600 + p(1) * 60 + p(2)).otherwise(p(0) * 60 + p(1))).otherwise(F.nullif(leading_float(s), F.lit(0.0)))


def iso_seconds(c: Column | str) -> Column:
    """F16. Seconds of an ISO duration anywhere in a text, fractions kept; null for none and for zero."""
    pattern = r"PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?"
    s = col(c)
    return F.when(s.rlike(pattern), F.nullif(_iso_part(s, 1, pattern) * 3600 + _iso_part(s, 2, pattern) * 60 + _iso_part(s, 3, pattern), F.lit(0.0)))


def padded(n: Column, width: int) -> Column:
    """A number with zeros before it up to a width; longer ones stay whole, where lpad would cut them."""
    s = n.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def clock(sec: Column | str) -> Column:
    """F17. HH:MM:SS of whole seconds."""
    s = col(sec).cast("bigint")
    return F.concat_ws(":", padded(F.floor(s / 3600), 2), padded(F.floor(s / 60) % 60, 2), padded(s % 60, 2))


def clock_of(c: Column | str) -> Column:
    """F17. HH:MM:SS of anything seconds reads; null if it can't."""
    s = seconds(c)
    return F.when(s.isNotNull(), clock(s))


def short_iso(sec: Column | str) -> Column:
    """F18. ISO duration without zero parts; PT0S for zero."""
    s = F.greatest(F.lit(0).cast("bigint"), _half_up(col(sec).cast("double")))
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    return F.when(col(sec).isNotNull(), F.concat(F.lit("PT"), part(h, "H"), part(m, "M"), F.when((r > 0) | ((h == 0) & (m == 0)), F.concat(r.cast("string"), F.lit("S"))).otherwise("")))


def full_iso(sec: Column | str) -> Column:
    """F19. ISO duration with hours, minutes and seconds, no leading zeros."""
    s = _half_up(col(sec).cast("double"))
    return F.when(col(sec).isNotNull(), F.format_string("PT%dH%dM%dS", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))


def iso_date(c: Column | str) -> Column:
    """F20. YYYY-MM-DD of y-m-d or m/d/y; null for other forms. Months and days aren't checked."""
    s = trimmed(col(c).cast("string"))
    ymd, mdy = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    g = lambda pattern, n: F.lpad(F.regexp_extract(s, pattern, n), 2, "0")
    return F.when(s.rlike(ymd), F.concat_ws("-", F.regexp_extract(s, ymd, 1), g(ymd, 2), g(ymd, 3))).when(s.rlike(mdy), F.concat_ws("-", F.regexp_extract(s, mdy, 3), g(mdy, 1), g(mdy, 2)))


def year(c: Column | str) -> Column:
    """F21. The first four digits in a row."""
    return F.regexp_extract(col(c).cast("string"), r"(\d{4})", 1).try_cast("int")


def serial_date(v: Column | str) -> Column:
    """F22. YYYY-MM-DD of a spreadsheet's day number, counted from 1899-12-30."""
    return F.date_format(F.date_from_unix_date((F.floor(col(v)) - 25569).cast("int")), "yyyy-MM-dd")


def day_fraction_clock(v: Column | str) -> Column:
    """F23. HH:MM:SS of a fraction of a day."""
    return clock(_half_up(col(v).cast("double") * 86400))


def sheet_value(c: Column | str, duration: bool = False) -> Column:
    """F22, F23, P13. A cell as text: fractions of a day in duration columns and day numbers are written out; null for blank."""

    def of(text: Column) -> Column:
        number = F.when(text.rlike(rf"^{_FLOAT}$"), text.try_cast("double"))
        out = F.when((number > 40000) & (number < 70000), serial_date(number)).otherwise(text)
        return F.when((number >= 0) & (number < 1), day_fraction_clock(number)).otherwise(out) if duration else out

    return bound(clean(c), of)


# Tokens that mean yes.
YES = ("yes", "true", "1", "e", "explicit", "cleared", "sync")


def yes(c: Column | str) -> Column:
    """F24. Whether a token means yes; null for null."""
    return F.lower(trimmed(col(c).cast("string"))).isin(*YES)


def explicit_flag(parental: Column | str, explicit: Column | str) -> Column:
    """F39. Catalogue rule: the first of the two that isn't blank says Explicit, or the second says Yes."""
    first = F.coalesce(F.when(~blank(parental), col(parental)), F.when(~blank(explicit), col(explicit)))
    return F.coalesce(first == "Explicit", F.lit(False)) | F.coalesce(col(explicit) == "Yes", F.lit(False))


def explicit_flag_either(parental: Column | str, explicit: Column | str) -> Column:
    """F39. Content-system rule: the one says Explicit or the other says Yes."""
    return F.coalesce(col(explicit) == "Yes", F.lit(False)) | F.coalesce(col(parental) == "Explicit", F.lit(False))


def number_in_container(c: Column | str) -> Column:
    """F27. Track number that starts the file name in a container reference: 'movie:07 Song.wav' or a URL."""
    v = col(c)
    name = F.when(v.startswith("movie:"), trimmed(F.regexp_replace(F.split(v, "\r")[0], "movie:", ""))).otherwise(F.split(F.substring_index(v, "/", -1), r"\?")[0])
    return leading_int(name)


def barcode_and_number(c: Column | str) -> Column:
    """F28. struct(barcode, seq) of '{barcode}_{x}_{seq}.wav'; null unless there are three parts and a number at the end."""
    parts = F.split(F.regexp_replace(basename(clean(c)), r"(?i)\.wav$", ""), "_")
    seq = leading_int(F.try_element_at(parts, F.lit(-1)))
    barcode = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 2)), "_")
    return F.when((F.size(parts) >= 3) & (barcode != "") & seq.isNotNull(), F.struct(barcode.alias("barcode"), seq.alias("seq")))


def md5_upper(content: Column | str) -> Column:
    """F35. MD5 of bytes or text, in upper-case hex."""
    return F.upper(F.md5(col(content)))


def stored_md5(c: Column | str, content: Column | str) -> Column:
    """F35. A stored hash if it looks like one, else that of the content."""
    return F.when(col(c).rlike("^[A-Fa-f0-9]{32}$"), F.upper(col(c))).otherwise(md5_upper(content))


def audio_format(content: Column | str) -> Column:
    """F36. wav, mp3, flac, aiff or unknown by the first bytes; null for null."""
    head = F.hex(F.substring(col(content), 1, 4))
    return (
        F.when(head.startswith("52494646"), "wav")
        .when(head.rlike("^FF[EF]"), "mp3")
        .when(head.startswith("494433"), "mp3")
        .when(head.startswith("664C6143"), "flac")
        .when(head.startswith("464F524D"), "aiff")
        .when(col(content).isNotNull(), "unknown")
    )


def is_wave(content: Column | str) -> Column:
    """F36. Whether bytes start like a RIFF/WAVE file."""
    return F.hex(F.substring(col(content), 1, 12)).rlike("^52494646.{8}57415645")


def is_jpeg(content: Column | str) -> Column:
    """F36. Whether bytes start like a JPEG."""
    return F.hex(F.substring(col(content), 1, 3)) == "FFD8FF"


def decoded(content: Column | str) -> Column:
    """S21. Text of UTF-8, UTF-16LE or UTF-16BE bytes by their mark, without it."""
    head = F.hex(F.substring(col(content), 1, 2))
    text = F.when(head == "FFFE", F.decode(col(content), "UTF-16LE")).when(head == "FEFF", F.decode(col(content), "UTF-16BE")).otherwise(F.decode(col(content), "UTF-8"))
    return F.regexp_replace(text, r"^\uFEFF", "")


def slash_date(c: Column | str) -> Column:
    """F42. MM/DD/YYYY of an ISO date; empty for anything else."""
    s = trimmed(F.coalesce(col(c).cast("string"), F.lit("")))
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(F.substring(s, 6, 2), F.lit("/"), F.substring(s, 9, 2), F.lit("/"), F.substring(s, 1, 4))).otherwise("")


def mount_line(c: Column | str, scheme: str = "moviemac:") -> Column:
    """F41. What follows the scheme on the first line that starts with it; null if none."""
    line = F.regexp_extract(col(c), rf"(?m)^[ \t]*{scheme}(.*)$", 1)
    return F.when(col(c).rlike(rf"(?m)^[ \t]*{scheme}"), trimmed(line))


def bucket_and_key(path: Column | str, anchor: str, buckets: list[str]) -> Column:
    """F40. struct(bucket, key) of a path: what follows the anchor, else from the first known bucket on. Null without a key."""
    p = col(path)
    rest = F.when(p.contains(anchor), F.substring(p, F.instr(p, anchor) + len(anchor), F.length(p)))
    for b in buckets:
        rest = F.coalesce(rest, F.when(p.contains(f"{b}/"), F.substring(p, F.instr(p, f"{b}/"), F.length(p))))
    rest = F.regexp_replace(rest, "^/+", "")
    bucket, key = F.substring_index(rest, "/", 1), F.regexp_extract(rest, "^[^/]+/(.+)$", 1)
    return F.when(rest.contains("/") & (bucket != "") & (key != ""), F.struct(bucket.alias("bucket"), key.alias("key")))


def key_of_url(url: Column | str, bucket: str) -> Column:
    """F44. Object key of a URL into a bucket, by host or by path; null for others."""
    u = col(url)
    host, path = F.try_parse_url(u, F.lit("HOST")), F.regexp_replace(F.try_parse_url(u, F.lit("PATH")), "^/", "")
    inside = F.when(host.startswith(f"{bucket}."), path).when(F.substring_index(path, "/", 1) == bucket, F.regexp_replace(path, f"^{bucket}/?", ""))
    return F.try_url_decode(F.replace(inside, F.lit("+"), F.lit("%2B")))


def is_reference(c: Column | str) -> Column:
    """P26. Whether a container value looks like something to fetch; placeholders don't."""
    s = trimmed(F.coalesce(col(c), F.lit("")))
    return (F.lower(s) != "untitled") & s.rlike("(?i)^(https?:|movie:|image:|file:|sound:)")


def track_artist(track: Column | str, album: Column | str) -> Column:
    """F45. The track's artist; the album's, in its spelling, if that is blank or the same."""
    t, a = clean(track), clean(album)
    return F.when(t.isNull() | (F.lower(t) == F.lower(a)), a).otherwise(t)


def asset_number(asset: Column | str, catalogue: Column | str, seq: Column | str) -> Column:
    """F46. The asset number without white space; else catalogue number and padded sequence."""
    given = F.nullif(col(asset), F.lit(""))
    default = F.concat_ws("_", F.coalesce(F.nullif(col(catalogue), F.lit("")), F.lit("TRK")), padded(col(seq), 3))
    return F.regexp_replace(F.coalesce(given, default), f"[{WHITE}]+", "")


def wave_name(name: Column | str, asset: Column) -> Column:
    """F46. The file name if it is a .wav, else the asset's."""
    return F.when(col(name).rlike(r"(?i)\.wav$"), col(name)).otherwise(F.concat(asset, F.lit(".wav")))


def partner_lines(catalogue: Column | str, label: Column | str, p_line: Column | str, c_line: Column | str, prefix: str, owner: str, short: str, this_year: int) -> Column:
    """F38. struct(label, p_line, c_line) of a partner's catalogue: its own label, and default lines that name the sheet's label."""
    ours = trimmed(F.coalesce(col(catalogue), F.lit(""))).rlike(f"(?i)^{prefix}")
    default = lambda mark, line: F.coalesce(clean(line), F.when(ours & clean(label).isNotNull(), F.concat(F.lit(f"{mark} {this_year} "), clean(label), F.lit(f" under exclusive license to {short}"))))
    return F.struct(F.when(ours, F.lit(owner)).otherwise(clean(label)).alias("label"), default("℗", p_line).alias("p_line"), default("©", c_line).alias("c_line"))


def intake_value(c: Column, kind: str) -> Column:
    """F47. A typed cell as text: the date of a timestamp, the clock of an interval or time text, else as it is."""
    if kind.startswith(("timestamp", "date")):
        return F.date_format(c, "yyyy-MM-dd")
    return c.cast("string")


def json_field(c: Column | str, name: str) -> Column:
    """F48. A field of a JSON text, as text."""
    return F.get_json_object(col(c), f"$.{name}")


def object_stem(c: Column | str) -> Column:
    """File name of a URL or path without its extension."""
    return stem(basename(c))
