"""Keys, names, labels and frame arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL_DIRS = ["0_real", "1_fake"]
#: Type names by original_type.
FAKE_TYPES = {
    "realvideo-realaudio": "Real",
    "realvideo-fakeaudio": "Audio Fake",
    "fakevideo-realaudio": "Video Fake",
    "fakevideo-fakeaudio": "Audio + Video Fake",
}


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def normal_path(path: Column) -> Column:
    """Null is empty; trimmed, surrounding quotes gone, forward slashes, none doubled."""
    p = F.trim(F.coalesce(path, F.lit("")))
    p = F.regexp_replace(F.regexp_replace(p, '^"+|"+$', ""), "^'+|'+$", "")
    return F.regexp_replace(F.regexp_replace(p, r"\\", "/"), "//+", "/")


def video_key(path: Column) -> Column:
    """The video that a frame belongs to: label directory and sample name by the first rule that matches, else the path."""
    parts = F.split(path, "/")
    name, parent = stem(path), F.when(F.size(parts) > 1, F.element_at(parts, -2))
    sample = F.coalesce(
        F.when(name.rlike(r"(?i)^(group|frame)_\d+$"), parent),
        F.nullif(F.regexp_extract(name, r"(?i)^(.+?_pair_.+?)_seg\d+_\d+$", 1), F.lit("")),
        F.nullif(F.regexp_extract(name, r"(?i)^(.+?)_seg\d+_\d+$", 1), F.lit("")),
        F.nullif(F.regexp_extract(name, r"^(.+)_\d+$", 1), F.lit("")),
    )
    label = F.get(F.reverse(F.filter(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.lower(x).isin(LABEL_DIRS))), F.lit(0))
    return F.when(sample.isNull(), path).when(label.isNull(), sample).otherwise(F.concat(label, F.lit("/"), sample))


def parse_label(label: Column, original: Column) -> Column:
    s, o = F.lower(F.trim(label)), F.lower(F.trim(original))
    return F.when(s.isin("real", "0", "false"), 0).when(s.isin("fake", "1", "true"), 1).when(o == "realvideo-realaudio", 0).when(o != "", 1)


def to_bool(value: Column) -> Column:
    s = F.lower(F.trim(value))
    return F.coalesce(s.isin("1", "true", "yes", "y", "t") | (F.expr("0.0") != s.try_cast("double")), F.lit(False))


def pair_type(video: Column, audio: Column) -> Column:
    """RR, RF, FR or FF: is the video forged, is the audio."""
    return F.concat(F.when(video, "F").otherwise("R"), F.when(audio, "F").otherwise("R"))


def clip_type(video: Column, audio: Column, n_fakes: Column | None = None) -> Column:
    """pair_type of two flags in any spelling; where both are absent and n_fakes is given, FF if it is positive, else RR."""
    by_flags = pair_type(to_bool(video), to_bool(audio))
    if n_fakes is None:
        return by_flags
    return F.when(video.isNull() & audio.isNull(), F.when(n_fakes > 0, "FF").otherwise("RR")).otherwise(by_flags)


#: The types that count as forged, by task.
FORGED = {"visual": ["FR", "FF"], "audio": ["RF", "FF"], "any": ["RF", "FR", "FF"]}


def binary_label(kind: Column, task: str) -> Column:
    return kind.isin(*FORGED[task]).cast("int")


#: The outcomes of an extraction task, and families of them. Every other outcome is a failure.
FAMILIES = {
    "ok": "saved", "skipped_existing": "existing",
    "budget_exhausted": "over_budget", "segment_exceeds_budget": "over_budget",
    "segment_too_short_for_min_frames": "too_few_frames", "saved_frames_below_min": "too_few_frames",
}
FAILURES = ["invalid_period", "source_missing", "open_failed", "invalid_video_info", "empty_segment", "json_write_failed", "no_valid_frames"]


def outcome_family(status: Column) -> Column:
    """What an outcome counts as; every other one, errors included, is a failure."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair))[status], F.lit("failed"))


def task_status(
    room: Column, t0: Column, t1: Column, source_there: Column, done: Column, opened: Column, fps: Column, total: Column, saved: Column, written: Column,
    least: int = 0, skip: int = 1, expand: bool = True, must_reach: bool = True, must_fit: bool = True,
) -> Column:
    """The outcome of an extraction task, by the first rule that applies.

    Before anything is looked at: is budget left, are both bounds of the period numbers, is the source there, has the
    task been done. Then of the video: does it open, has it a rate and frames, is the segment in it, can it (widened, if
    expand) give least frames of every skip-th one, do these fit the budget. Then of what came out: fewer saved than
    least, none, or an index that could not be written. least = 0 sets no lower bound; bounds may be texts; a null of
    what is known only later (opened, fps, saved, written) counts as a failure of that step.
    """
    begin, end = t0.cast("string").try_cast("double"), t1.cast("string").try_cast("double")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    s, e = frame_range(begin, end, fps, total)
    empty = no(e > s)
    if least > 0 and expand:
        s, e = expand_segment(s, e, total, least, skip)
    frames = frame_count(e - s, skip)
    steps = [
        ("budget_exhausted", no(room > 0)), ("invalid_period", begin.isNull() | end.isNull()), ("source_missing", no(source_there)), ("skipped_existing", F.coalesce(done, F.lit(False))),
        ("open_failed", no(opened)), ("invalid_video_info", no((fps > 0) & (total > 0))), ("empty_segment", empty),
        ("segment_too_short_for_min_frames", F.lit(least > 0 and must_reach) & (frames < least)), ("segment_exceeds_budget", F.lit(must_fit) & (frames > room)),
        ("saved_frames_below_min", F.lit(least > 0) & no(saved >= least)), ("no_valid_frames", no(saved > 0)), ("json_write_failed", no(written)),
    ]
    out = F.lit("ok")
    for name, rule in reversed(steps):
        out = F.when(rule, name).otherwise(out)
    return out


def filled(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(default))


def sanitized(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)[^\p{Alnum}._-]", "_")


def seeded(key: Column, seed: int) -> Column:
    """An order that any engine reproduces."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary"))


def frame_range(t0: Column, t1: Column, fps: Column, total: Column) -> tuple[Column, Column]:
    s = F.greatest(F.lit(0), F.floor(t0 * fps))
    return F.least(s, total).cast("long"), F.least(F.greatest(F.ceil(t1 * fps), F.lit(0)), total).cast("long")


def spaced(start: Column, stop: Column, n: Column) -> Column:
    """n whole numbers evenly from start to stop: products in doubles, floored, the last one stop itself."""
    step = F.when(n > 1, (stop - start).cast("double") / (n - 1)).otherwise(F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when((i == n - 1) & (n > 1), stop).otherwise(F.floor(i * step + start)).cast("long"))


def windows(variant: int, start: Column, end: Column, length: int, n: int) -> Column:
    """Starts of up to n windows of length frames in [start, end), by one of four rules; empty if none fits."""
    none = F.expr("cast(array() as array<bigint>)")
    total = end - start
    if variant == 1:
        return F.when(total <= length, none).otherwise(spaced(start, end - length - 1, F.lit(n)))
    if variant == 2:
        return F.when(total <= 0, none).when(total <= length, F.array_repeat(F.lit(0).cast("long"), n)).otherwise(spaced(start, F.greatest(end - length - 1, F.lit(0)), F.lit(n)))
    room = total - length + (0 if variant == 3 else 1)
    last = end - length - (1 if variant == 3 else 0)
    return F.when(room < 1, none).otherwise(F.array_distinct(spaced(start, last, F.least(F.lit(n), room).cast("int"))))


def fake_type(original: Column, audio: Column, video: Column) -> Column:
    """The type by its original name; failing that by the labels of the two tracks; failing that Unknown."""
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    tracks = F.concat(plain(video), F.lit("video-"), plain(audio), F.lit("audio"))
    names = F.create_map(*(F.lit(x) for pair in FAKE_TYPES.items() for x in pair))
    return F.coalesce(names[plain(original)], names[tracks], F.lit("Unknown"))


def expand_segment(start: Column, end: Column, total: Column, min_frames: int, skip: int) -> tuple[Column, Column]:
    """A segment that holds min_frames of every skip-th frame, if total allows: widened evenly, then into what is left on either side."""
    if min_frames <= 0:
        return start, end
    span = (min_frames - 1) * skip + 1
    need = F.lit(span) - (end - start)
    left = F.floor(need / 2)
    s, e = F.greatest(F.lit(0), start - left), F.least(total, end + need - left)
    s2 = F.greatest(F.lit(0), s - F.greatest(F.lit(0), F.lit(span) - (e - s)))
    e2 = F.when(e < total, F.least(total, e + F.greatest(F.lit(0), F.lit(span) - (e - s2)))).otherwise(e)
    return F.when(need <= 0, start).otherwise(s2).cast("long"), F.when(need <= 0, end).otherwise(e2).cast("long")


def normalized(values: Column, mean: list[float], std: list[float]) -> Column:
    """Per channel (x / 255 - mean) / std of an array with one value a channel."""
    of = F.array(*(F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in zip(mean, std)))
    return F.zip_with(values, of, lambda x, c: (x / F.lit(255.0) - c["m"]) / c["s"])


def is_absolute(path: Column) -> Column:
    """Of either system: a drive letter with a slash, or a leading slash; back slashes count as slashes."""
    return F.regexp_replace(path, r"\\", "/").rlike("^(?:[A-Za-z]:)?/")


def is_windows_absolute(path: Column) -> Column:
    """A drive letter, a colon and a slash, of the path as normal_path gives it."""
    return normal_path(path).rlike("^[A-Za-z]:/")


def column_span(start: Column, length: int, per_frame: Column, columns: Column) -> tuple[Column, Column]:
    """First and end (exclusive) of the columns that belong to length frames: both rounded to even, one column at least, within columns."""
    begin = F.greatest(F.lit(0), F.least(F.rint(start * per_frame), columns - 1))
    return begin.cast("long"), F.greatest(begin + 1, F.least(F.rint((start + length) * per_frame), columns)).cast("long")


def image_id(name: Column) -> Column:
    """metadata_id and frame_index of an image's name (the part before the last _ and the digits behind it), null if it has another form."""
    own, form = stem(name), r"^(.+)_(\d+)$"
    return F.when(own.rlike(form), F.struct(F.regexp_extract(own, form, 1).alias("metadata_id"), F.regexp_extract(own, form, 2).cast("long").alias("frame_index")))


def frame_count(span: Column, skip: int) -> Column:
    """How many frames every skip-th of span ones are: the quotient, rounded up."""
    return F.floor((span + skip - 1) / skip).cast("long")


def box_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def rounded_product(x: Column, digits: int = 2) -> Column:
    """Rounds the product with the power of ten, ties to even: 2.675 gives 2.68."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def rounded_exactly(x: Column, digits: int = 2) -> Column:
    """Rounds the double's exact value, ties to even: 2.675, a little less than it looks, gives 2.67.

    The product with the power of ten is exactly p + e, where x is split into halves whose products are exact; where p
    is a tie, e decides.
    """
    ten = F.lit(10.0**digits)
    wide = x * 134217729.0
    high = wide - (wide - x)
    p = x * ten
    e = (high * ten - p) + (x - high) * ten
    down = F.floor(p).cast("double")
    return F.when((p - down == 0.5) & (e != 0), F.when(e > 0, down + 1).otherwise(down)).otherwise(F.rint(p)) / ten


def number_list(text: Column) -> Column:
    """A list of numbers that commas separate."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x).cast("double"))


def number_range(text: Column) -> Column:
    """A whole number, or all from the first to the second of two; more than two are an error."""
    own = F.transform(F.split(text, ","), lambda x: F.trim(x).cast("int"))
    none = F.raise_error(F.concat(F.lit("more than two bounds: "), text)).cast("array<int>")
    first, last = F.get(own, F.lit(0)), F.get(own, F.lit(1))
    return F.when(F.size(own) > 2, none).when(F.size(own) == 1, own).when(first > last, F.expr("cast(array() as array<int>)")).otherwise(F.sequence(first, F.greatest(first, last)))


def clock(seconds: Column) -> Column:
    """Hours, minutes and seconds of a duration."""
    h, rest = F.floor(seconds / 3600), F.pmod(seconds, F.lit(3600))
    return F.struct(h.cast("long").alias("hours"), F.floor(rest / 60).cast("long").alias("minutes"), F.pmod(rest, F.lit(60)).cast("double").alias("seconds"))


def local_time(utc: Column, hours: int = 8) -> Column:
    """A UTC time as clocks that many hours ahead show it."""
    return F.date_format(utc + F.make_dt_interval(F.lit(0), F.lit(hours)), "yyyy-MM-dd HH:mm:ss")


def without_suffix_mark(name: Column, mark: str = "sf") -> Column:
    """A legacy name under its present form: the mark before the digits at its end goes."""
    return F.regexp_replace(name, rf"_{mark}(\d+)$", "_$1")


def without_prefixes(key: Column, prefixes: tuple[str, ...] = ("module", "_orig_mod")) -> Column:
    """A parameter's key without the wrappers that name it, however often they repeat."""
    return F.regexp_replace(key, rf"^(({'|'.join(prefixes)})\.)+", "")


def aligned_begin(t: Column, fake_duration: Column, real_duration: Column) -> Column:
    """The time of one video that belongs to a time of another, by their durations; a duration of almost none counts as such."""
    return t / F.greatest(fake_duration, F.lit(1e-8)) * real_duration
