"""Text functions with the archive's semantics, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.canonical import last_keys

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z only; other letters stay."""
    return F.translate(text, _UPPER, _LOWER)


def contains_ascii_folded(text: Column, literal: str) -> Column:
    """A literal substring match in which A-Z and a-z are equal; % and _ have no meaning."""
    return F.contains(ascii_lower(text), ascii_lower(F.lit(literal)))


def like_literal(text: Column, literal: str) -> Column:
    """The same as a LIKE pattern with its wildcards escaped."""
    escaped = literal.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.like(ascii_lower(text), ascii_lower(F.lit(f"%{escaped}%")), F.lit("\\"))


def contains_folded(text: Column, literal: str) -> Column:
    """A substring match without regard to case in any script."""
    return F.contains(F.lower(text), F.lower(F.lit(literal)))


def collapse_space(text: Column) -> Column:
    """Every run of white space (in any script) as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clip(text: Column, query: str, size: Column | int) -> dict[str, Column]:
    """text_offset (0-based), clipped text, full length and truncated: a window of size code points that starts a quarter of
    it before the first match of query, or at 0."""
    size = F.lit(size) if isinstance(size, int) else size
    found = F.instr(ascii_lower(text), query.translate(str.maketrans(_UPPER, _LOWER)))
    start = F.greatest(F.lit(0), F.when(found > 0, found - 1 - F.floor(size / 4)).otherwise(0)).cast("int")
    return {"text_offset": start, "text": F.substring(text, start + 1, size.cast("int")), "length": F.length(text), "truncated": (start > 0) | (F.length(text) > start + size)}


def media_class(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(suffix == "json", "json").when(suffix == "dat", "dat").when(suffix.isin("html", "htm"), "html").otherwise("other")


def json_pointer_component(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def normal_asset_reference(reference: Column) -> Column:
    """The last path component of a reference without fragment, query and scheme; null if nothing is left."""
    bare = F.rtrim(F.regexp_replace(F.regexp_replace(reference, r"(?U)^\s+|\s+$", ""), r"(?s)[#?].*$", ""), F.lit("/"))
    path = F.rtrim(F.regexp_replace(bare, r"(?s)^.*?://", ""), F.lit("/"))
    return F.nullif(F.substring_index(path, "/", -1), F.lit(""))


#: Kinds of records by the names of their files.
RECORD_KINDS = {
    "group_chats.json": "group_chats",
    "shared_conversations.json": "shared_conversation",
    "message_feedback.json": "message_feedback",
    "library_files.json": "library_file",
    "conversation_asset_file_names.json": "conversation_asset_registry",
    "user_settings.json": "user_settings",
    "user.json": "user",
    "ads.json": "ads",
    "export_manifest.json": "provider_export_manifest",
}


def record_kind(path: Column) -> Column:
    """The kind of an export file's records; unknown files are named by their stem."""
    name = F.substring_index(path, "/", -1)
    kinds = F.create_map(*[F.lit(x) for pair in RECORD_KINDS.items() for x in pair])
    other = F.concat(F.lit("provider_json:"), F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
    return F.when(F.rlike(name, F.lit(r"^conversations(-[0-9]+)?\.json$")), "conversation").otherwise(F.coalesce(F.try_element_at(kinds, name), other))


def native_id(kind: Column, raw: Column) -> Column:
    """The first text among the keys that hold a record's id; keys depend on the kind."""
    record = F.try_parse_json(last_keys(raw))
    text = lambda key: F.when(F.schema_of_variant(F.try_variant_get(record, f"$.{key}", "variant")) == "STRING", F.try_variant_get(record, f"$.{key}", "string"))
    return F.when(kind == "library_file", text("file_id")).when(kind == "message_feedback", F.coalesce(text("id"), text("message_id"))).when(kind.isin("conversation", "shared_conversation"), F.coalesce(text("id"), text("conversation_id"))).otherwise(text("id"))


def captured_micros(value: Column) -> Column:
    """Epoch microseconds of an ISO-8601 time; without a zone it is UTC; null if it is no time."""
    bare = F.trim(value)
    zoned = F.rlike(bare, F.lit(r"(?i)(z|[+-][0-9]{2}:?[0-9]{2})$")) & F.contains(bare, F.lit(":"))
    return F.unix_micros(F.try_to_timestamp(F.when(zoned, bare).otherwise(F.concat(bare, F.when(F.length(bare) <= 10, "T00:00:00Z").otherwise("Z")))))


#: Media types by the suffixes of file names.
MIME_TYPES = {
    "csv": "text/csv",
    "gif": "image/gif",
    "htm": "text/html",
    "html": "text/html",
    "jpeg": "image/jpeg",
    "jpg": "image/jpeg",
    "json": "application/json",
    "mp3": "audio/mpeg",
    "mp4": "video/mp4",
    "pdf": "application/pdf",
    "png": "image/png",
    "svg": "image/svg+xml",
    "txt": "text/plain",
    "wav": "audio/x-wav",
    "webp": "image/webp",
    "zip": "application/zip",
}


def mime_type(name: Column) -> Column:
    """The media type a file's name speaks of, or null."""
    types = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.try_element_at(types, F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)))


def array_length(json: Column) -> Column:
    """The number of elements of a JSON array; 0 for anything else."""
    return F.coalesce(F.json_array_length(json), F.lit(0)).cast("long")


def safe_component(text: Column) -> Column:
    """Only letters, digits, dot, underscore and hyphen; other runs become a hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")


def display_time(seconds: Column) -> Column:
    """UTC time of an epoch in seconds; 'unknown' for null and for zero or less."""
    return F.when(seconds > 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss 'UTC'")).otherwise("unknown")


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator to six places; 0.0 where the denominator is 0."""
    return F.coalesce(F.round(F.try_divide(numerator.cast("double"), denominator.cast("double")), 6), F.lit(0.0))


def validity(valid_from: Column, valid_until: Column, as_of: str, superseded: Column) -> Column:
    """Where a statement's dates (ISO text) stand on a day."""
    day = F.lit(as_of)
    return (
        F.when(superseded, "outdated")
        .when(valid_until < day, "expired")
        .when(valid_from > day, "future")
        .when(valid_from.isNotNull() | valid_until.isNotNull(), "within_user_stated_period")
        .otherwise("historical_unverified")
    )


def message_text(raw: Column) -> Column:
    """The text of a message's JSON: content.text, then the parts that are texts or have one, joined by line ends; empty ones
    count; of repeated keys the last one does. Anything without content gives an empty text."""
    kind = lambda v: F.schema_of_variant(v)
    record = F.try_parse_json(last_keys(raw))
    own = F.try_variant_get(record, "$.content.text", "variant")
    parts = F.coalesce(F.try_variant_get(record, "$.content.parts", "array<variant>"), F.array().cast("array<variant>"))
    part = lambda v: F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")).when(kind(F.try_variant_get(v, "$.text", "variant")) == "STRING", F.try_variant_get(v, "$.text", "string"))
    first = F.when(kind(own) == "STRING", F.try_variant_get(own, "$", "string"))
    return F.array_join(F.concat(F.array(first), F.transform(parts, part)), "\n")
