"""Name, key and text rules as Column expressions. No Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the naming rules.
ARTICLES = ["the", "a", "an", "le", "la", "les", "el", "los", "las", "der", "die", "das", "il", "lo", "gli"]
NUMERALS = {"ii": 2, "iii": 3, "iv": 4, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "xi": 11, "xii": 12, "xiii": 13, "xiv": 14, "xv": 15}
COUNTRIES = ["usa", "europe", "japan", "world", "asia", "australia", "brazil", "canada", "china", "france", "germany", "italy", "korea", "netherlands", "spain", "sweden", "taiwan", "uk", "unknown", "latin america", "scandinavia", "russia", "hong kong"]
LANGUAGES = ["en", "ja", "jp", "fr", "de", "es", "it", "nl", "pt", "ru", "ko", "zh", "sv", "fi", "no", "da", "pl"]
RELEASES = ["virtual console", "wii virtual console", "wii u virtual console", "3ds virtual console", "switch online", "nso", "genesis mini", "mega drive mini", "snes mini", "snes classic", "nes classic", "nes mini", "playstation classic", "ps classic", "sega channel", "gametap", "eshop", "psn", "playchoice-10", "vs.", "broadband adapter", "satellaview", "sufami turbo", "32x"]
STATUS = {"prototype": ["proto", "prototype"], "beta": ["beta"], "demo": ["demo"], "sample": ["sample"], "unlicensed": ["unl", "unlicensed"], "homebrew": ["homebrew", "aftermarket"]}
SIDE_EXTENSIONS = [".cue", ".m3u", ".sub", ".txt", ".nfo", ".jpg", ".jpeg", ".png", ".gif", ".xml", ".dat", ".sav", ".srm", ".state", ".oops"]
ARCHIVES = [".zip", ".7z"]
EXTENSION_RANK = {".sfc": 0, ".smc": 1, ".z64": 0, ".n64": 1, ".v64": 2, ".gb": 0, ".gbc": 0, ".gba": 0, ".md": 0, ".gen": 1, ".smd": 2, ".bin": 3}
CONFIDENCE_RANK = {"unmatched": 0, "fuzzy": 1, "header": 2, "dat_verified": 3}
COVER_KINDS = {"boxart": "Named_Boxarts", "box": "Named_Boxarts", "images": "Named_Boxarts", "named_boxarts": "Named_Boxarts", "screenshots": "Named_Snaps", "snaps": "Named_Snaps", "named_snaps": "Named_Snaps", "titles": "Named_Titles", "wheel": "Named_Titles", "title": "Named_Titles", "named_titles": "Named_Titles"}
DEVICES = ["con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))]
REVISION = r"(?i)^(rev\s+\S+|v\d+(\.\d+[a-z]?)?|\d+\.\d+[a-z]?)$"
DISC = r"(?i)^(?:disc|disk|side)\s+([0-9A-Za-z]+)(?:\s+of\s+\d+)?$"
VERSION_END = r"(?i)\s*(v\d+(\.\d+[a-z]?)?|\d+\.\d+[a-z]?|rev\s*\d+)\s*$"
GROUP = r"\([^()]*\)|\[[^\[\]]*\]"
UNRANKED = 2**31 - 1


def lookup(column: Column, values: dict, default: Column | None = None) -> Column:
    """A small fixed mapping as CASE."""
    out = F
    for k, v in values.items():
        out = out.when(column == k, F.lit(v))
    return out.otherwise(default) if default is not None else out


def bound(value: Column, body) -> Column:
    """body of a value that is evaluated once a row, however often body names it: Spark evaluates an expression anew at each place where it stands in a condition or a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def _tags(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.trim(x))


def paren_tags(text: Column) -> Column:
    return _tags(text, r"\(([^()]*)\)")


def bracket_tags(text: Column) -> Column:
    return F.transform(_tags(text, r"\[([^\[\]]*)\]"), lambda x: F.lower(x))


def first_tag(tags: Column, test) -> Column:
    return F.get(F.filter(tags, test), F.lit(0))


def is_revision(tag: Column) -> Column:
    return tag.rlike(REVISION)


def is_disc(tag: Column) -> Column:
    return tag.rlike(DISC)


def _plain(tag: Column) -> Column:
    """Not one of the tags that come before regions."""
    return ~is_revision(tag) & ~is_disc(tag)


def is_region(tag: Column) -> Column:
    """Every part between commas is a region or language."""
    parts = F.filter(F.transform(F.split(tag, ","), lambda p: F.lower(F.trim(p))), lambda p: p != "")
    known = F.array(*map(F.lit, COUNTRIES + LANGUAGES))
    return _plain(tag) & (F.size(parts) > 0) & F.forall(parts, lambda p: F.array_contains(known, p))


def is_release(tag: Column) -> Column:
    return _plain(tag) & F.lower(tag).isin(RELEASES)


def has_status(tags: Column, kind: str) -> Column:
    return F.exists(tags, lambda t: F.lower(t).isin(STATUS[kind]))


def disc_number(tag: Column) -> Column:
    """Digits as they are, one letter by its place in the alphabet."""
    raw = F.regexp_extract(tag, DISC, 1)
    letter = F.ascii(F.upper(raw)) - 64
    return F.when(raw.rlike("^[0-9]+$"), raw.try_cast("int")).when(raw.rlike("^[A-Za-z]$"), letter)


def clean_name(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(text, GROUP, ""), r"(?U)\s+", " ")), r"[\s_\-]+$", "")


def article_first(name: Column) -> Column:
    """'Family, The' as 'The Family'."""
    pattern = rf"(?i)^(.*?)\s*,\s*({'|'.join(ARTICLES)})\s*$"
    turned = lambda n: F.concat(F.initcap(F.regexp_extract(n, pattern, 2)), F.lit(" "), F.rtrim(F.regexp_extract(n, pattern, 1)))
    return bound(name, lambda n: F.when(F.contains(n, F.lit(",")) & n.rlike(pattern), turned(n)).otherwise(n))


def fuzzy_key(name: Column, release: Column | None = None) -> Column:
    """Articles, numerals and version endings folded; only small letters and digits are left."""
    words = F.filter(F.split(article_first(name), r"(?U)\s+"), lambda w: w != "")
    words = bound(words, lambda ws: F.when(F.lower(F.get(ws, F.lit(0))).isin(ARTICLES), F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1)))).otherwise(ws))
    words = F.transform(words, lambda w: bound(F.lower(F.regexp_replace(w, "[^A-Za-z0-9]", "")), lambda k: lookup(k, {k: str(v) for k, v in NUMERALS.items()}, w)))
    key = F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.array_join(words, " "), VERSION_END, ""))), "[^a-z0-9]", "")
    return key if release is None else with_release(key, release)


def with_release(key: Column, release: Column) -> Column:
    """A key with its release behind it, if there is one."""
    end = F.regexp_replace(F.lower(F.coalesce(release, F.lit(""))), "[^a-z0-9]", "")
    return bound(end, lambda e: F.when(e != "", F.concat(key, F.lit("__"), e)).otherwise(key))


def parsed(name: Column) -> dict[str, Column]:
    """The fields of a file name."""
    s = stem(name)
    tags, marks = paren_tags(s), bracket_tags(s)
    release, clean = first_tag(tags, is_release), clean_name(s)
    shown = article_first(clean)
    return {
        "clean_name": clean,
        "display_title": F.when(release.isNotNull(), F.concat(shown, F.lit(" ("), release, F.lit(")"))).otherwise(shown),
        "extension": extension(name),
        "region": first_tag(tags, is_region),
        "revision": first_tag(tags, is_revision),
        "disc_number": disc_number(first_tag(tags, is_disc)),
        "release_type": release,
        "is_verified": F.array_contains(marks, "!"),
        "is_bad_dump": F.exists(marks, lambda m: m.rlike(r"^b\d*$")),
        "is_hack": F.exists(marks, lambda m: m.rlike(r"^h\d*$")),
        "is_translation": F.exists(marks, lambda m: m.rlike("^t[+-]")),
        "is_overdump": F.exists(marks, lambda m: m.rlike(r"^o\d*$")),
        "is_alternate": F.exists(marks, lambda m: m.rlike(r"^a\d*$")),
        **{f"is_{k}": has_status(tags, k) for k in STATUS},
        "fuzzy_key": fuzzy_key(clean, release),
    }


def registry_tokens(name: Column) -> dict[str, Column]:
    """The identity fields of a registry's game name (without an extension)."""
    tags = paren_tags(name)
    return {"title": clean_name(name), "region": first_tag(tags, is_region), "revision": first_tag(tags, is_revision), "is_hack": F.exists(bracket_tags(name), lambda m: m.rlike(r"^h\d*$")), "is_homebrew": has_status(tags, "homebrew")}


def safe_filename(name: Column) -> Column:
    """Characters that file systems refuse become '_'; device names get one in front."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_")), r"[. ]+$", "")
    return F.when(F.lower(F.substring_index(clean, ".", 1)).isin(DEVICES), F.concat(F.lit("_"), clean)).otherwise(clean)


def thumbnail_name(name: Column) -> Column:
    return F.translate(name, '&*/:\\<>?|"', "_" * 10)


def url_path(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def title_key(text: Column) -> Column:
    """Groups dropped, letters of any script and digits kept."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, GROUP, "")), r"(?U)[\W_]", "")


def title_key_ascii(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def crc_key(text: Column, clamp: bool) -> Column:
    """Eight hex digits; longer values are cut to their last eight (clamp) or refused."""
    raw = F.regexp_replace(F.lower(F.trim(text)), "^0x", "")
    ok = raw.rlike("^[0-9a-f]+$") if clamp else raw.rlike("^[0-9a-f]{1,8}$")
    return F.when(ok, F.right(F.lpad(raw, F.greatest(F.length(raw), F.lit(8)), F.lit("0")), F.lit(8)))


def release_year(text: Column) -> Column:
    year = F.regexp_extract(F.trim(text), "^([0-9]{4})", 1).try_cast("int")
    return F.when(year.between(1970, 2100), year)


def valid_hash(text: Column) -> Column:
    return text.rlike("^[0-9a-f]+$") & F.length(text).isin(8, 32, 40)


def valid_relative_path(text: Column, allow_empty: bool = False) -> Column:
    """Forward slashes only, no drive or absolute path, no way up, no control characters, no device names (with any ending)."""
    segments = F.filter(F.split(text, "/"), lambda x: x != "")
    bad = F.exists(segments, lambda x: (x == "..") | x.rlike(r"[\x00-\x1f]") | F.lower(F.substring_index(F.regexp_replace(x, "[. ]+$", ""), ".", 1)).isin(DEVICES))
    ok = ~text.rlike(r"[:\\\x00]") & ~text.startswith("/") & (F.size(segments) > 0) & ~bad
    return F.when(text == "", F.lit(allow_empty)).otherwise(ok)


def thumbnail_url(base: str, system: Column, name: Column, cover_type: Column) -> Column:
    return F.concat_ws("/", F.lit(base.rstrip("/")), url_path(system), cover_type, F.concat(url_path(thumbnail_name(name)), F.lit(".png")))


def cover_cache_path(root: str, system: Column, name: Column, cover_type: Column) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), system, cover_type, F.concat(thumbnail_name(name), F.lit(".png")))


def is_sidecar(path: Column) -> Column:
    segments = F.split(F.lower(path), "/")
    name = F.element_at(segments, -1)
    return (name == "gamelist.xml") | name.endswith(".m3u") | F.arrays_overlap(segments, F.array(*map(F.lit, ["downloaded_media", "imgs", "media"])))


def is_multi_disc(name: Column) -> Column:
    low = F.lower(name)
    return low.contains("(disc ") | low.contains("(cd ") | low.contains("(disk ")


def disc_base(name: Column) -> Column:
    return F.trim(F.regexp_replace(stem(name), r"(?i)\s*\((disc|cd|disk)\s[^()]*\)", ""))


def cover_kind(path: Column) -> Column:
    """From the parent folder, else from its parent, else box art."""
    segments = F.split(F.lower(path), "/")
    at = lambda k: lookup(F.try_element_at(segments, F.lit(-k)), COVER_KINDS)
    return F.coalesce(at(2), at(3), F.lit("Named_Boxarts"))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def size_text(n: Column, unit: int = 1024, zero: str = "0 B") -> Column:
    """One decimal place, rounded half up by whole-number arithmetic."""
    out = F.when(n <= 0, zero).when(n < unit, F.concat(n.cast("string"), F.lit(" B")))
    for k, name in enumerate(["KB", "MB", "GB", "TB"], start=1):
        tenths = F.floor((n * 20 + unit**k) / F.lit(2 * unit**k)).cast("long")
        text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {name}"))
        out = out.when(n < unit ** (k + 1), text) if name != "TB" else out.otherwise(text)
    return out


def short_hash(text: Column) -> Column:
    return F.when(F.length(text) > 12, F.concat(F.left(text, F.lit(8)), F.lit("…"), F.right(text, F.lit(4)))).otherwise(text)


def drifted(size_a: Column, size_b: Column, time_a: Column, time_b: Column) -> Column:
    return (size_a != size_b) | (F.abs(time_a - time_b) >= 2.0)


def confidence_rank(column: Column) -> Column:
    return lookup(column, CONFIDENCE_RANK, F.lit(0))


def extension_rank(column: Column) -> Column:
    return lookup(column, EXTENSION_RANK, F.lit(UNRANKED))
