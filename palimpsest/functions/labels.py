"""Column expressions for names, sizes, times, colours and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File kinds, blend modes and the names shown for them.
EXTENSIONS = ("kra", "gpl", "kpl", "aco", "ase")
BLEND_MODES = {"multiply": "multiply", "svg:multiply": "multiply", "screen": "screen", "svg:screen": "screen", "overlay": "overlay", "svg:overlay": "overlay", "add": "add", "linear_dodge": "add"}
STATUS_VERBS = {"M": "Updated", "A": "Added", "D": "Deleted", "R": "Renamed", "C": "Needs review", "U": "New"}
ASSET_KINDS = {"kra": "Artwork", "gpl": "Palette", "png": "Reference", "jpg": "Reference", "jpeg": "Reference", "webp": "Reference"}
LAYER_TYPES = {
    "paintlayer": "Paint",
    "grouplayer": "Group",
    "filterlayer": "Filter",
    "adjustmentlayer": "Filter",
    "clonelayer": "Clone",
    "shapelayer": "Vector",
    "vectorlayer": "Vector",
    "filelayer": "File",
    "transparencymask": "Mask",
    "transformmask": "Mask",
    "selectionmask": "Mask",
    "filtermask": "Mask",
}
LAYER_CHANGES = {"added": "Added", "removed": "Removed", "modified": "Modified", "unchanged": "Unchanged"}
OPERATIONS = {"commit": "Save", "switch": "Switch", "merge": "Merge", "diff": "Compare", "create": "New line", "delete": "Delete", "rollback": "Restore"}
BYTE_UNITS = ("KB", "MB", "GB", "TB")
#: Attributes of a layer that are a choice of the artist's.
LAYER_ATTRIBUTES = ("name", "opacity", "compositeop", "visible", "x", "y")


def _named(key: Column, names: dict[str, str], otherwise: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(table[key], otherwise)


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("bigint")), 2, "0") for c in (r, g, b)])


def unit_to_byte(v: Column) -> Column:
    """0..1 to 0..255, half up."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255).cast("int")


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    return [unit_to_byte((1 - v) * (1 - k)) for v in (c, m, y)]


def opacity_percent(opacity: Column) -> Column:
    return F.round(opacity * 100.0 / 255.0).cast("int")


def blend_mode(mode: Column) -> Column:
    return _named(mode, BLEND_MODES, F.lit("normal"))


def status_verb(status: Column) -> Column:
    return _named(status, STATUS_VERBS, status)


def iso_time(epoch: Column) -> Column:
    """Seconds since 1970 as UTC; the session's time zone must be UTC."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def age(seconds: Column) -> Column:
    whole = lambda n: F.floor(seconds / n).cast("bigint").cast("string")
    return F.when(seconds < 60, F.concat(seconds.cast("bigint").cast("string"), F.lit("s"))).when(seconds < 3600, F.concat(whole(60), F.lit("m"))).otherwise(F.concat(whole(3600), F.lit("h")))


def saved_percent(actual: Column, naive: Column) -> Column:
    """Nearest per cent saved; at most 99 if anything is stored, at least 1 if anything is saved."""
    saved = F.greatest(F.lit(0), naive - actual)
    nearest = F.floor(saved * 100.0 / naive + 0.5).cast("int")
    nearest = F.when((actual > 0) & (nearest > 99), 99).when((saved > 0) & (nearest < 1), 1).otherwise(nearest)
    return F.when(naive <= 0, 0).otherwise(nearest)


def _scaled(size: Column, values: list) -> Column:
    """The one of `values` that belongs to a size in bytes, KB, MB, GB or TB."""
    out = F.lit(values[-1])
    for k in range(len(values) - 2, -1, -1):
        out = F.when(size < 1024 ** (k + 1), F.lit(values[k])).otherwise(out)
    return out


def byte_unit(size: Column) -> Column:
    return _scaled(size, ["B", *BYTE_UNITS])


def byte_tenths(size: Column) -> Column:
    """The size in tenths of its unit, half up."""
    return F.floor(size * 10.0 / _scaled(size, [1024**k for k in range(len(BYTE_UNITS) + 1)]) + 0.5).cast("bigint")


def _tenths(tenths: Column) -> Column:
    return F.concat(F.floor(tenths / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string"))


def byte_text(size: Column) -> Column:
    """"840 B", "1.4 KB"."""
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(F.concat(_tenths(byte_tenths(size)), F.lit(" "), byte_unit(size)))


def ms_text(ms: Column) -> Column:
    """"840ms", "1.3s"."""
    short = F.concat(F.floor(ms + 0.5).cast("bigint").cast("string"), F.lit("ms"))
    return F.when(ms < 1000, short).otherwise(F.concat(_tenths(F.floor(ms / 100 + 0.5).cast("bigint")), F.lit("s")))


def operation_label(operation: Column, plain: bool = False) -> Column:
    """The operation's name with a capital, or, with `plain`, what an artist calls it."""
    capital = F.concat(F.upper(F.substring(operation, 1, 1)), operation.substr(F.lit(2), F.length(operation)))
    return _named(operation, OPERATIONS, operation) if plain else capital


def relative_time(then: Column, now: Column) -> Column:
    """"just now", "5m ago", "2h ago", "3d ago", or the day from a week on; times are timestamps."""
    then, now = then.cast("timestamp"), now.cast("timestamp")
    minutes = F.floor((F.unix_millis(now) - F.unix_millis(then)) / 60000 + 0.5)
    hours = F.floor(minutes / 60 + 0.5)
    days = F.floor(hours / 24 + 0.5)
    ago = lambda n, unit: F.concat(n.cast("bigint").cast("string"), F.lit(f"{unit} ago"))
    out = F.when(minutes < 1, "just now").when(minutes < 60, ago(minutes, "m")).when(hours < 24, ago(hours, "h")).when(days < 7, ago(days, "d"))
    return out.otherwise(F.date_format(then, "MMM d"))


def full_timestamp(time: Column) -> Column:
    """"Jun 26, 2026 · 14:32"."""
    return F.date_format(time, "MMM d, yyyy · HH:mm")


def layer_id(uuid: Column, name: Column) -> Column:
    return F.coalesce(F.when(uuid != "", uuid), name)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def palette_key(path: Column) -> Column:
    """The lower-cased file name without a palette's ending and without a version of digits after a dot."""
    return F.regexp_replace(F.regexp_replace(F.lower(file_name(path)), r"\.(kpl|gpl|aco|ase)$", ""), r"\.[0-9]+$", "")


def _spaced(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, "[-_]+", " "))


def title_case(text: Column) -> Column:
    """Hyphens and underscores as spaces, runs of spaces as one, and a capital for each word; the rest keeps its case."""
    words = F.filter(F.split(_spaced(text), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def _base(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def asset_name(path: Column) -> Column:
    """The file name without its extension, hyphens and underscores as spaces."""
    return F.coalesce(F.nullif(_spaced(F.regexp_replace(_base(path), r"\.[^.]+$", "")), F.lit("")), _base(path))


def palette_name(path: Column) -> Column:
    """A palette's own name: of an embedded one what follows the last `::`, without extension and version."""
    base = _base(F.substring_index(path, "::", -1))
    stem = F.regexp_replace(F.regexp_replace(base, r"\.[^.]+$", ""), r"\.[0-9]+$", "")
    return F.coalesce(F.nullif(_spaced(stem), F.lit("")), base)


def asset_kind(path: Column) -> Column:
    return _named(F.lower(F.substring_index(path, ".", -1)), ASSET_KINDS, F.lit("Settings"))


def layer_type(kind: Column) -> Column:
    other = F.when(kind == "", "Layer").otherwise(title_case(F.regexp_replace(kind, "layer$", "")))
    return _named(kind, LAYER_TYPES, other)


def layer_change(change: Column) -> Column:
    return _named(change, LAYER_CHANGES, change)


def version_label(version: Column) -> Column:
    return F.concat(F.lit("Version "), version.cast("string"))


def stash_title(label: Column, paths: Column) -> Column:
    """The label, or the first two files of an unlabelled stash and how many more there are."""
    names = F.transform(paths, asset_name)
    few = F.array_join(F.slice(names, 1, 2), ", ")
    unlabelled = F.when(F.size(names) == 0, "Empty").when(F.size(names) <= 2, few).otherwise(F.concat(few, F.lit(" +"), (F.size(names) - 2).cast("string")))
    return F.when(F.trim(label) != "", label).otherwise(unlabelled)


def stash_summary(files: Column, branch: Column, then: Column, now: Column) -> Column:
    """"3 files · on main · 2h ago"."""
    return F.concat(files.cast("string"), F.when(files == 1, " file · on ").otherwise(" files · on "), branch, F.lit(" · "), relative_time(then, now))


def layer_signature(attributes: dict[str, Column]) -> Column:
    """What makes two versions of a layer the same but for its pixels: `attributes` by name, null for absent ones."""
    return F.concat_ws("\0", *[F.concat(F.lit(f"{k}="), F.coalesce(attributes[k].cast("string"), F.lit(""))) for k in LAYER_ATTRIBUTES])


def xml_escape(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def xml_attribute(key: str, value: Column) -> Column:
    return F.concat(F.lit(f'{key}="'), value, F.lit('"'))


def with_name(opening_tag: Column, escaped: Column) -> Column:
    """An opening tag with another value of its own `name` attribute, null where it has none."""
    parts = r'(?s)^(.*? name=")[^"]*(".*)$'
    found = F.concat(F.regexp_extract(opening_tag, parts, 1), escaped, F.regexp_extract(opening_tag, parts, 2))
    return F.when(opening_tag.rlike(parts), found)


def fresh_uuid(seed: Column, counter: Column) -> Column:
    """A brace-quoted id in the shape of a UUID, from a seed."""
    digits = F.sha2(F.concat_ws("\0", F.lit("merge"), seed, counter.cast("string")), 256)
    return F.concat(F.lit("{"), F.concat_ws("-", *[F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit("}"))


def embedded_palette(entry: Column) -> Column:
    """Whether an archive's entry is a palette: in a folder of palettes, or by its ending."""
    low = F.lower(entry)
    return low.contains("palettes/") | low.rlike(r"\.(gpl|kpl|aco|ase)$")


def compressed(payload: Column) -> Column:
    """Whether bytes begin as a PNG, a zip or a zstd frame does."""
    return F.startswith(payload, F.lit(b"\x89PNG")) | F.startswith(payload, F.lit(b"PK\x03\x04")) | F.startswith(payload, F.lit(b"\x28\xb5\x2f\xfd"))


def default_pixel(raw: Column) -> Column:
    """Blue, green, red, alpha to red, green, blue, alpha; null unless there are four bytes."""
    return F.when(F.octet_length(raw) == 4, F.concat(*[F.substring(raw, k, 1) for k in (3, 2, 1, 4)]))


def object_name(content: Column, base: Column) -> Column:
    """The object that holds a version: a snapshot, or a patch against its base."""
    return F.when(base.isNull(), F.concat(content, F.lit(".full"))).otherwise(F.concat(content, F.lit("."), base, F.lit(".patch")))


def file_key(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def manifest_key(path: Column) -> Column:
    return F.concat(F.lit("kra:"), path, F.lit(":manifest"))


def entry_key(path: Column, entry: Column) -> Column:
    return F.concat(F.lit("kra:"), path, F.lit(":entry:"), entry)


def tile_key(path: Column, entry: Column, x: Column, y: Column) -> Column:
    return F.concat(F.lit("kra:"), path, F.lit(":tile:"), entry, F.lit(":"), x.cast("string"), F.lit(","), y.cast("string"))


def supported(path: Column) -> Column:
    return F.lower(path).rlike(rf"\.({'|'.join(EXTENSIONS)})$") & ~F.lower(path).endswith("-autosave.kra")


def safe_path(path: Column) -> Column:
    """A relative path that cannot leave its root."""
    parts = F.split(path, "/")
    return (path != "") & ~path.startswith("/") & ~path.startswith("./") & (path != ".") & ~F.array_contains(parts, "..")


def branch_name_valid(name: Column) -> Column:
    """1 to 60 bytes after trimming, without control characters or any of / \\ : * ? " < > |."""
    trimmed = F.trim(name)
    return F.octet_length(trimmed).between(1, 60) & ~trimmed.rlike(r'[\x00-\x1F\x7F/\\:*?"<>|]')


def shard_of(key: Column) -> Column:
    """The tracked file that a stream key belongs to: all that follows `file:`, or what stands between `kra:` and the first
    marker of tiles, else of entries, else a manifest's ending; other keys are their own."""
    rest = key.substr(F.lit(5), F.length(key))
    cut = F.when(rest.contains(":tile:"), F.substring_index(rest, ":tile:", 1)).when(rest.contains(":entry:"), F.substring_index(rest, ":entry:", 1))
    return F.when(key.startswith("file:"), key.substr(F.lit(6), F.length(key))).when(key.startswith("kra:"), cut.otherwise(F.regexp_replace(rest, ":manifest$", ""))).otherwise(key)


def content_id(parts: list[Column], length: int = 12) -> Column:
    """A short id of some fields; null counts as a dash."""
    return F.substring(F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]), 256), 1, length)
