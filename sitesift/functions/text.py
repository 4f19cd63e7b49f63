"""Text, code, path, URL, date and JSON rules as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitesift.functions.geometry import col

# Limits and formats of the records.
MAX_URL = 8192
DECODE_PASSES = 64
MAX_ARCHIVE_PATH = 240
MIN_YEAR = 1850
DXF_CHUNK = 240
CONTROL = r"[\x00-\x1f\x7f]"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
PROVIDER_ID = r"^[a-z][a-z0-9-]{0,63}$"
RESULT_IDENTITY = r"^[A-Za-z0-9][A-Za-z0-9._~-]{0,199}$"
SHA256 = r"^[a-f0-9]{64}$"
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,3})?(?:Z|[+-]\d{2}:\d{2})$"
DEVICE_NAME = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"
PLAIN_DECIMAL = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
EXPORT_FORMATS = ("png", "png8", "png24", "png32", "jpg", "jpeg")


def _known(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def has_text(value) -> Column:
    return _known(F.length(F.trim(col(value))) > 0)


def bounded_text(value, maximum: int) -> Column:
    """Non-blank, free of control characters and at most ``maximum`` long."""
    value = col(value)
    return has_text(value) & (F.length(value) <= maximum) & ~value.rlike(CONTROL)


# -- unit codes and colours -------------------------------------------------


def code_pattern(codes: list[str]) -> str:
    """A code standing as its own token, whatever is around it."""
    return r"(?<![0-9a-z_])(" + "|".join(codes) + r")(?![0-9a-z])"


def surficial_code(text) -> Column:
    """First surficial unit code named in the text, lower case, else null."""
    from sitesift.operators.legends import surficial_codes

    found = F.regexp_extract(F.lower(F.trim(col(text))), code_pattern(surficial_codes()), 1)
    return F.nullif(found, F.lit(""))


def bedrock_code(text) -> Column:
    """Leading bedrock unit code, optionally with the geophysics prefix g."""
    found = F.regexp_extract(F.lower(F.trim(col(text))), r"^(g?\d{1,2}[a-z]?)(?:\s|$)", 1)
    return F.nullif(found, F.lit(""))


def kml_color(text) -> Column:
    """AABBGGRR to STRUCT<color '#rrggbb', opacity>; null when malformed."""
    hex8 = F.lower(F.regexp_replace(F.trim(col(text)), "^#", ""))
    color = F.concat(
        F.lit("#"), F.substring(hex8, 7, 2), F.substring(hex8, 5, 2), F.substring(hex8, 3, 2))
    opacity = F.conv(F.substring(hex8, 1, 2), 16, 10).cast("double") / 255
    return F.when(hex8.rlike("^[0-9a-f]{8}$"), F.struct(
        color.alias("color"), opacity.alias("opacity")))


def legend_label(code, name, official_title) -> Column:
    """STRUCT<code, title, heading>: the code leads, once, official titles are upper case."""
    code = F.upper(F.trim(F.coalesce(col(code), F.lit(""))))
    official = F.nullif(F.trim(col(official_title)), F.lit(""))
    title = F.trim(F.coalesce(
        official, F.nullif(F.trim(col(name)), F.lit("")), F.lit("Geology unit")))
    rest = F.substring(title, F.length(code) + F.lit(1), F.length(title))
    led = (F.length(code) > 0) & F.startswith(F.upper(title), code) & rest.rlike(
        r"^(\s*[—–:-]|\s)")
    stripped = F.trim(F.regexp_replace(rest, r"^(\s*[—–:-]\s*|\s+)", ""))
    bare = F.when(led & (F.length(stripped) > 0), stripped).otherwise(title)
    shown = F.when(official.isNotNull(), F.upper(bare)).otherwise(bare)
    heading = F.concat_ws(" ", F.nullif(code, F.lit("")), F.nullif(shown, F.lit("")))
    return F.struct(code.alias("code"), shown.alias("title"), heading.alias("heading"))


# -- escaping and cleaning --------------------------------------------------


def csv_cell(text) -> Column:
    """Cell text with formulas neutralised, CRLF line ends and quoting."""
    raw = col(text).cast("string")
    safe = F.when(raw.rlike(r"^[\t \r\n]*[=+\-@]"), F.concat(F.lit("'"), raw)).otherwise(raw)
    lines = F.regexp_replace(safe, r"\r\n?|\n", "\r\n")
    quoted = F.concat(F.lit('"'), F.replace(lines, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(lines.rlike('[",\r\n]'), quoted).otherwise(lines)


def xml_escape(text) -> Column:
    out = col(text).cast("string")
    for raw, entity in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def _code_units(point: Column) -> Column:
    offset = point - 65536
    high = F.hex(F.lit(0xD800) + F.shiftright(offset, 10))
    low = F.hex(F.lit(0xDC00) + offset.bitwiseAND(1023))
    pair = F.concat(F.lit("\\U+"), high, F.lit("\\U+"), low)
    single = F.concat(F.lit("\\U+"), F.lpad(F.hex(point), 4, "0"))
    return F.when(point <= 65535, single).otherwise(pair)


def dxf_escape(text) -> Column:
    """ARRAY<STRING> of chunks of at most 240 characters, non-ASCII as \\U+XXXX."""
    text = F.coalesce(col(text).cast("string"), F.lit(""))
    chars = F.when(F.length(text) > 0, F.transform(
        F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1))))

    def token(ch: Column) -> Column:
        code = F.ascii(ch)
        plain = code.between(32, 126) & ~ch.isin("\\", "{", "}", "%", "^", "~")
        return (
            F.when(ch == "\n", F.lit("\\P"))
            .when((code < 32) | (code == 127), F.lit(" "))
            .when(plain, ch)
            .otherwise(_code_units(code))
        )

    def pack(acc: Column, t: Column) -> Column:
        last = F.element_at(acc, -1)
        full = (F.length(last) > 0) & (F.length(last) + F.length(t) > DXF_CHUNK)
        extended = F.concat(
            F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, t)))
        return F.when(full, F.concat(acc, F.array(t))).otherwise(extended)

    packed = F.aggregate(F.transform(chars, token), F.array(F.lit("")), pack)
    return F.coalesce(packed, F.array(F.lit(" ")))


def clean_description(text) -> Column:
    """Commas, line ends and blanks become underscores; default SPOT_ELEV."""
    given = F.coalesce(F.nullif(col(text), F.lit("")), F.lit("SPOT_ELEV"))
    trimmed = F.regexp_replace(given, r"^\s+|\s+$", "")
    cleaned = F.regexp_replace(F.regexp_replace(trimmed, r"[,\r\n]+", "_"), r"\s+", "_")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("SPOT_ELEV"))


def strip_html(text) -> Column:
    """Visible text of an HTML fragment by regular expressions.

    An approximation: head, script, style, comments and tags go, the common
    entities are decoded and white space collapses; there is no HTML parser.
    """
    out = col(text)
    for pattern in (
        r"(?is)<head\b.*?</head>", r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>",
        r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        out = F.regexp_replace(out, pattern, "")
    for entity, char in (
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
        ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[\s\x{00A0}]+", " "))


def _accent_table() -> tuple[str, str]:
    """Latin letters whose compatibility decomposition leads with an ASCII letter."""
    src, dst = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFKD", chr(code))
        bare = "".join(c for c in parts if not unicodedata.combining(c))
        if len(bare) == 1 and bare.isascii() and bare.isalnum():
            src.append(chr(code))
            dst.append(bare)
    return "".join(src), "".join(dst)


ACCENTED, UNACCENTED = _accent_table()


def slug(text, limit: int = 96, fallback: str = "Image", lower: bool = False) -> Column:
    """File-name stem: accents dropped, other characters to single dashes.

    Covers the Latin letters; ``slug_full`` does every script's decomposition.
    """
    plain = F.regexp_replace(F.translate(col(text), ACCENTED, UNACCENTED), r"\p{M}+", "")
    return _dashed(plain, limit, fallback, lower)


def _dashed(plain: Column, limit: int, fallback: str, lower: bool) -> Column:
    if lower:
        plain = F.lower(plain)
    dashed = F.regexp_replace(F.regexp_replace(plain, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(dashed, 1, limit), "-+$", "")
    stem = F.coalesce(F.nullif(cut, F.lit("")), F.lit(fallback))
    prefix = "project-" if lower else f"{fallback}-"
    return F.when(stem.rlike(DEVICE_NAME), F.concat(F.lit(prefix), stem)).otherwise(stem)


@F.pandas_udf(T.StringType())
def _decompose(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKD")


def slug_full(text, limit: int = 96, fallback: str = "Image", lower: bool = False) -> Column:
    """``slug`` with full NFKD; the decomposition is the only Arrow step."""
    plain = F.regexp_replace(_decompose(col(text)), r"\p{M}+", "")
    return _dashed(plain, limit, fallback, lower)


# -- surveys ----------------------------------------------------------------


def parse_elevations(text) -> Column:
    """ARRAY<STRUCT<raw, value, valid, round>> of the dd.dd / ddd.dd numbers in a label."""
    dotted = F.replace(F.coalesce(col(text), F.lit("")), F.lit(","), F.lit("."))
    found = F.regexp_extract_all(dotted, F.lit(r"(?<!\d)(\d{2,3}\.\d{2})(?!\d)"), F.lit(1))
    return F.transform(found, lambda raw: F.struct(
        raw.alias("raw"), raw.cast("double").alias("value"),
        raw.cast("double").between(0, 999).alias("valid"),
        raw.endswith(".00").alias("round"),
    ))


def spot_selected(include, value) -> Column:
    """Marked for export and carrying a finite value."""
    finite = F.abs(col(value)) < float("inf")
    return _known(col(include) & finite)


def ranged_elevation(value, has_mark, count, low, high) -> Column:
    """STRUCT<value, status, include, confidence> of one number read from a label."""
    value = col(value)
    valid = _known(value.between(0, 999) & (value >= col(low)) & (value <= col(high)))
    auto = valid & _known(col(has_mark)) & (col(count) == 1)
    return F.struct(
        F.when(valid, value).alias("value"),
        F.when(auto, "OK").otherwise("REVIEW").alias("status"),
        auto.alias("include"),
        F.when(auto, F.lit(0.95)).when(valid, F.lit(0.58)).otherwise(F.lit(0.25))
        .alias("confidence"),
    )


# -- catalog names ----------------------------------------------------------

# Service-name patterns of the two municipal directories.
SERVICE_YEAR = {
    "toronto": r"^basemap/(?:cot_historic_aerial_(\d{4})|cot_ortho_(\d{4})_[A-Za-z0-9]+(?:_[A-Za-z0-9]+)*)$",
    "ottawa": r"^Basemap_Imagery_(\d{4})$",
}


def service_name_year(name, provider: str) -> Column:
    """STRUCT<year, resolution_m> from a service name; null when it is not imagery."""
    name, pattern = col(name), SERVICE_YEAR[provider]
    year = F.regexp_extract(name, pattern, 1)
    if provider == "toronto":
        year = F.coalesce(F.nullif(year, F.lit("")), F.regexp_extract(name, pattern, 2))
    cm = F.nullif(F.regexp_extract(name, r"_([0-9]+)cm$", 1), F.lit(""))
    return F.when(name.rlike(pattern), F.struct(
        year.cast("int").alias("year"),
        (cm.cast("double") / 100 if provider == "toronto" else F.lit(None).cast("double"))
        .alias("resolution_m"),
    ))


def _listed(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda v: F.trim(v))


def export_policy(copyright_text, capabilities, formats, max_width, max_height,
                  allowed=("City of Toronto",)) -> Column:
    """exportable / link-only / unknown from a service's own metadata."""
    verified = _known(F.trim(col(copyright_text)).isin(*allowed))
    maps = F.array_contains(_listed(col(capabilities)), "Map")
    images = F.arrays_overlap(
        F.transform(_listed(col(formats)), lambda v: F.lower(v)),
        F.array(*[F.lit(f) for f in EXPORT_FORMATS]))
    sized = _known((col(max_width) > 0) & (col(max_height) > 0))
    return (
        F.when(~verified, "unknown").when(maps & images & sized, "exportable")
        .otherwise("link-only")
    )


def historical_code(year, sequence) -> Column:
    year, sequence = col(year), col(sequence)
    return F.when(sequence > 0, F.format_string("H-%d-%d", year, sequence))


# -- dates ------------------------------------------------------------------


def valid_year(year, max_year) -> Column:
    return _known(col(year).between(MIN_YEAR, col(max_year)))


def valid_date(text) -> Column:
    """YYYY-MM-DD naming a real day."""
    text = col(text)
    return _known(text.rlike(r"^\d{4}-\d{2}-\d{2}$")
                  & F.try_to_date(text, "yyyy-MM-dd").isNotNull())


def parsed_timestamp(text) -> Column:
    text = col(text)
    return F.when(text.rlike(TIMESTAMP) & (F.length(text) <= 40), F.try_to_timestamp(text))


def valid_timestamp(text) -> Column:
    return parsed_timestamp(text).isNotNull()


# -- links, paths and URLs --------------------------------------------------


def follow_link(name, href) -> Column:
    """Named as the surficial layer, or a KML/KMZ under the polygon path."""
    name = F.lower(F.trim(F.coalesce(col(name), F.lit(""))))
    href = F.lower(F.trim(F.coalesce(col(href), F.lit(""))))
    document = href.rlike(r"\.(?:kml|kmz)(?:[?#].*)?$")
    polygons = href.contains("/mrd128/polygons/") | href.contains("mrd128-cache/polygons/")
    return (name == "surficial geology") | (document & polygons)


def cache_path_ok(path) -> Column:
    return _known(col(path).rlike(r"^files/[A-Za-z0-9_-]+\.json$"))


def archive_path_ok(path) -> Column:
    """Relative printable path without traversal, empty parts or device names."""
    path = col(path)
    parts = F.split(path, "/")
    unsafe = F.exists(parts, lambda p: (
        (p == "") | p.isin(".", "..") | p.endswith(".")
        | F.split(p, r"\.")[0].rlike(DEVICE_NAME)))
    return _known(
        F.length(path).between(1, MAX_ARCHIVE_PATH)
        & path.rlike(r"^[A-Za-z0-9][A-Za-z0-9._/-]*$") & ~unsafe)


def _path_stays_safe(path: Column) -> Column:
    """Decode until stable (at most 64 passes) and inspect every stage."""

    def inspect(p: Column) -> Column:
        return (
            p.rlike(r"[\\\x00-\x1f\x7f\x{FFFD}]")
            | p.rlike(r"(?i)%(2f|5c|0[0-9a-f]|1[0-9a-f]|7f)")
            | F.exists(F.split(p, "/"), lambda s: s.isin(".", ".."))
        )

    def step(acc: Column, _: Column) -> Column:
        encoded = acc["path"].contains("%")
        plus = F.replace(acc["path"], F.lit("+"), F.lit("%2B"))
        decoded = F.when(encoded, F.try_url_decode(plus)).otherwise(acc["path"])
        return F.struct(
            decoded.alias("path"),
            (acc["bad"] | F.coalesce(inspect(acc["path"]), F.lit(True))).alias("bad"),
        )

    start = F.struct(path.alias("path"), F.lit(False).alias("bad"))
    passes = F.sequence(F.lit(1), F.when(path.contains("%"), DECODE_PASSES + 1).otherwise(1))
    end = F.aggregate(passes, start, step)
    return ~end["bad"] & end["path"].isNotNull() & ~F.coalesce(
        end["path"].rlike("%[0-9a-fA-F]{2}"), F.lit(True))


def resolve_url(href, base) -> Column:
    """The address that ``href`` has in a document at ``base``, for http and https.

    Absolute, scheme-relative, rooted, relative, query and fragment forms. Dot segments (also as %2e) are
    walked, scheme and host lowered, default ports dropped, backslashes read as slashes, spaces encoded. Null
    where ``base`` is no such address, and for other schemes.
    """
    plain = F.replace(F.regexp_replace(F.trim(F.coalesce(col(href), F.lit(""))), r"[\t\r\n]", ""), F.lit(" "), F.lit("%20"))
    head = F.regexp_extract(plain, r"^[^?#]*", 0)
    plain = F.concat(F.replace(head, F.lit("\\"), F.lit("/")), F.substr(plain, F.length(head) + 1))
    here = F.regexp_replace(col(base), "#.*", "")
    start = F.regexp_extract(here, r"(?i)^(https?://[^/?#]+)", 1)
    path = F.regexp_extract(here, r"(?i)^https?://[^/?#]+(/[^?#]*)?", 1)
    folder = F.concat(F.regexp_extract(path, r"^(.*/)?", 0), F.when(path == "", "/").otherwise(""))
    whole = (
        F.when(plain.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), plain)
        .when(plain.startswith("//"), F.concat(F.regexp_extract(start, "^[^/]*", 0), plain))
        .when(plain.startswith("/"), F.concat(start, plain))
        .when(plain.startswith("?"), F.concat(start, path, plain))
        .when((plain == "") | plain.startswith("#"), F.concat(here, plain))
        .otherwise(F.concat(start, folder, plain)))
    parts = r"(?i)^(https?)://([^/?#]+)([^?#]*)(.*)$"
    scheme, host = F.lower(F.regexp_extract(whole, parts, 1)), F.lower(F.regexp_extract(whole, parts, 2))
    host = F.regexp_replace(host, F.when(scheme == "http", ":80$").otherwise(":443$"), "")
    steps = F.split(F.regexp_replace(F.regexp_extract(whole, parts, 3), "^/", ""), "/")
    dots = F.transform(steps, lambda s: F.regexp_replace(s, "(?i)%2e", "."))
    walked = F.aggregate(
        F.arrays_zip(steps.alias("s"), dots.alias("d")), F.array().cast("array<string>"),
        lambda acc, x: F.when(x["d"] == ".", acc)
        .when(x["d"] == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x["s"])))
    end = F.when(F.element_at(dots, -1).isin(".", "..") & (F.size(walked) > 0), "/").otherwise("")
    known = whole.rlike(parts) & (start != "")
    return F.when(known, F.concat(scheme, F.lit("://"), host, F.lit("/"), F.array_join(walked, "/"), end, F.regexp_extract(whole, parts, 4)))


def url_origin(url) -> Column:
    return F.lower(F.regexp_extract(col(url), r"(?i)^(https://[^/?#]+)", 1))


def url_path(url) -> Column:
    path = F.regexp_extract(col(url), r"(?i)^[a-z]+://[^/?#]*(/[^?#]*)?", 1)
    return F.coalesce(F.nullif(path, F.lit("")), F.lit("/"))


def url_allowed(url, origins=None, roots=None, template: bool = False) -> Column:
    """https, no user info or fragment, a path that decodes safely, and, when
    given, an origin and a root of the provider's lists (ARRAY<STRING> columns)."""
    url = col(url)
    authority = F.regexp_extract(url, r"(?i)^https://([^/?#]*)", 1)
    shown = F.regexp_replace(url, r"(?i)\{(z|x|y|s|level|row|col)\}", "0") if template else url
    ok = (
        has_text(url) & (F.length(url) <= MAX_URL) & url.rlike(r"(?i)^https://[^/?#@\s]+")
        & ~authority.contains("@") & ~url.contains("#")
        & _path_stays_safe(url_path(url))
    )
    if template:
        ok = ok & ~shown.rlike(r"[{}]")
    if origins is not None:
        ok = ok & F.array_contains(col(origins), url_origin(url))
    if roots is not None:
        place = F.concat(url_origin(shown), url_path(shown))
        ok = ok & F.exists(col(roots), lambda r: F.startswith(place, r))
    return _known(ok)


# -- JSON and embedded data -------------------------------------------------


def plain_number(x) -> Column:
    """Shortest plain text of a double: no trailing zeros, no exponent."""
    x = col(x).cast("double")
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    short = F.abs(x).between(1e-3, 1e7)
    fixed = F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return (
        F.when(whole, x.cast("bigint").cast("string"))
        .when(short, x.cast("string")).otherwise(fixed)
    )


def _json_text(text: Column) -> Column:
    boxed = F.to_json(F.array(text))
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def stable_json(value, data_type: T.DataType) -> Column:
    """Compact JSON of a value of ``data_type`` with sorted keys and nulls kept."""
    value = col(value)
    if isinstance(data_type, T.StructType):
        fields = [
            F.concat(F.lit(f'"{f.name}":'), stable_json(value[f.name], f.dataType))
            for f in sorted(data_type.fields, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    elif isinstance(data_type, T.ArrayType):
        parts = F.transform(value, lambda v: stable_json(v, data_type.elementType))
        text = F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))
    elif isinstance(data_type, (T.DoubleType, T.FloatType)):
        text = plain_number(value)
    elif isinstance(data_type, (T.StringType, T.DateType, T.TimestampType)):
        text = _json_text(value.cast("string"))
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("null"))


def decode_data_url(text) -> Column:
    """STRUCT<mime, bytes> of a base64 image data URL; null when malformed."""
    text = col(text)
    pattern = r"(?i)^data:(image/[a-z0-9.+-]+);base64,([a-z0-9+/]*={0,2})$"
    data = F.try_to_binary(F.regexp_extract(text, pattern, 2), F.lit("base64"))
    return F.when(text.rlike(pattern) & data.isNotNull(), F.struct(
        F.lower(F.regexp_extract(text, pattern, 1)).alias("mime"), data.alias("bytes")))
