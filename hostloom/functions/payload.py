"""JSON payloads: strict parsing, type rules, decoding to the host sample, encoding.

The collectors' decoder is stricter than Spark's: one value of a wrong type or
any text after the document rejects the whole record. ``from_json`` does the
decoding and finds most of that; a scan of the text looks for what it lets
pass. Only texts that scan finds suspicious are parsed a second time, to a
variant whose value types can be asked for one by one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostloom.schemas import COUNTER_FIELDS, NIC, PAYLOAD, SERVICE_INFO, STATS, UINT64_MAX

TOP_KEYS = ("PluginName", "EventName", "Data")
HOST_PLUGIN = "host"



# --- the careful check -----------------------------------------------------
# SQL text: these expressions are long, and text is built faster than columns.


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _kind(v: str) -> str:
    """Type name of a variant; absent and JSON null are both VOID."""
    return f"coalesce(schema_of_variant({v}), 'VOID')"


def _member(v: str, key: str) -> str:
    return f"try_variant_get({v}, '$.{key}', 'variant')"


def _is_text(v: str) -> str:
    return f"{_kind(v)} IN ('STRING', 'VOID')"


def _is_number(v: str) -> str:
    finite = f"abs(try_variant_get({v}, '$', 'double')) < double('Infinity')"
    return f"({_kind(v)} = 'VOID' OR ({_kind(v)} RLIKE '^(BIGINT|DOUBLE|DECIMAL)' AND {finite}))"


def _is_uint64(v: str) -> str:
    whole = f"try_variant_get({v}, '$', 'decimal(38,0)')"
    return (f"({_kind(v)} = 'VOID' OR ({_kind(v)} RLIKE '^(BIGINT$|DECIMAL[(][0-9]+,0[)])' "
            f"AND {whole} BETWEEN 0 AND {UINT64_MAX}))")


def _is_object(v: str) -> str:
    return f"{_kind(v)} RLIKE '^(OBJECT<|VOID)'"


def _is_array(v: str, item: str, item_ok: str) -> str:
    items = f"try_variant_get({v}, '$', 'array<variant>')"
    return f"({_kind(v)} = 'VOID' OR ({_kind(v)} RLIKE '^ARRAY<' AND forall({items}, {item} -> {item_ok})))"


def _fits_sample(text: str) -> str:
    """SQL: the text is one JSON value that fits the payload schema, unknown keys aside.

    Spark's parser stops after the first value. Inside ``[ ]`` a stray ``]``
    would still pass and inside ``{ }`` a stray ``}``; no text passes both.
    """
    disk = " AND ".join([_is_object("d"), _is_text(_member("d", "mountpoint")),
                         _is_number(_member("d", "used_percent"))])
    fields = "struct<" + ",".join(f"{f.name}:variant" for f in NIC) + ">"
    nic = f"{_is_object('n')} AND " + _let("r", f"try_variant_get(n, '$', '{fields}')", " AND ".join([
        _is_text("r.mac"), _is_text("r.if_name"),
        f"{_kind('r.ips')} IN ('ARRAY<STRING>', 'ARRAY<VOID>', 'VOID')",
        *[_is_uint64(f"r.{name}") for name in COUNTER_FIELDS]]))
    data = _let("data", _member("doc", "Data"), " AND ".join([
        _is_object("data"),
        *[_is_number(_member("data", k)) for k in ("cpu", "memory")],
        *[_is_text(_member("data", k)) for k in ("uptime", "hostname", "os", "arch", "kernel")],
        _is_array(_member("data", "disk"), "d", disk),
        _is_array(_member("data", "networks"), "n", nic)]))
    sample = " AND ".join([_is_object("doc"), _is_text(_member("doc", "PluginName")),
                           _is_text(_member("doc", "EventName")), data])
    value = f"try_variant_get(try_parse_json('[' || {text} || ']'), '$[0]', 'variant')"
    # a variant forgets how a number was written, the raw text does not
    plain = " AND ".join(f"coalesce(get_json_object({text}, '$.Data.networks[*].{name}') NOT RLIKE '[.eE]', true)"
                         for name in COUNTER_FIELDS)
    single = f"size(json_object_keys('{{\"w\":' || {text} || '}}')) = 1"
    return f"coalesce({single} AND {plain} AND " + _let("doc", value, f"doc IS NOT NULL AND {sample}") + ", false)"


NESTED_KEYS = tuple(dict.fromkeys(
    ("cpu", "memory", "disk", "networks", "uptime", "hostname", "os", "arch", "kernel", "mountpoint", "used_percent",
     "mac", "ips", "if_name", *COUNTER_FIELDS)))
_KEYS = TOP_KEYS + NESTED_KEYS
_RESPELT = rf'"(?!(?:{"|".join(_KEYS)})")(?i:{"|".join(_KEYS)})"\s*:'
# cheaper, and true for all of these: a key with a capital where known keys have none, or a top key in small letters
_ODD_KEY = (rf'"(?:[a-z_]++[A-Z][A-Za-z_]*+|(?!(?:{"|".join(TOP_KEYS)})")[A-Z][A-Za-z_]*+|'
            rf'{"|".join(f"{k[0].lower()}(?i:{k[1:]})" for k in TOP_KEYS)})"\s*+:')


def canonical_keys(text: Column) -> Column:
    """Spell all known keys, at any level, exactly; their letter case is free on the wire.

    A quoted word before a colon is always a key, as quotes inside a JSON
    string are escaped. Texts with exact keys only are left alone. Of keys that
    become equal the last one counts, as for the original's decoder.
    """
    respelt = text
    for key in _KEYS:
        respelt = F.regexp_replace(respelt, rf'(?i)"{key}"(\s*:)', f'"{key}"$1')
    odd = F.rlike(text, F.lit(_ODD_KEY)) & F.rlike(text, F.lit(_RESPELT))
    return F.when(odd, respelt).otherwise(text)


def payload_text(payload: Column) -> Column:
    """JSON text of an envelope payload (binary or text)."""
    return canonical_keys(F.coalesce(payload.cast("string"), F.lit("")))


STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

_CORRUPT = "corrupt"
_DOCUMENT = T.StructType([T.StructField("sample", PAYLOAD), T.StructField(_CORRUPT, T.StringType())])


def document(text: Column) -> Column:
    """``struct<sample, corrupt>`` of a payload text.

    The text is parsed as a member of an object, so text after the document is
    an error here and ``null`` is a sample without any value.
    """
    return F.from_json(
        F.concat(F.lit('{"sample":'), text, F.lit("}")), _DOCUMENT,
        {**STRICT_JSON, "columnNameOfCorruptRecord": _CORRUPT},
    )


_NOT_TEXT = r'[^"\s]'
_NOT_NUMBER = r"(?:[^-0-9\s]|-?[0-9.]{300}|-?[0-9.]+[eE])"
_NOT_UINT64 = r"(?![0-9]{1,19}\s*[,}])"
# a list of texts has quotes at both ends, no escapes and only quotes behind its commas; no group repeats
_NOT_TEXTS = r'(?:(?!\[\s*(?:"[^\]\\]*"\s*)?\])|\[[^\]]*,\s*[^"\s])'
_WRONG_VALUE = {
    **dict.fromkeys(("PluginName", "EventName", "mountpoint", "mac", "if_name", "uptime",
                     "hostname", "os", "arch", "kernel"), _NOT_TEXT),
    **dict.fromkeys(("cpu", "memory", "used_percent"), _NOT_NUMBER),
    **dict.fromkeys(COUNTER_FIELDS, _NOT_UINT64),
    "ips": _NOT_TEXTS,
}


def _wrong_value_pattern() -> str:
    """A known key whose value does not plainly have the right type.

    Alternatives are grouped by first letter, so most quotes in a text are
    passed over after one character.
    """
    by_letter: dict[str, list[str]] = {}
    for key, wrong in _WRONG_VALUE.items():
        by_letter.setdefault(key[0], []).append(rf'{key[1:]}"\s*:\s*{wrong}')
    letters = "|".join(f"{c}(?:{'|'.join(tails)})" for c, tails in by_letter.items())
    return rf'"(?=[{"".join(by_letter)}])(?:{letters})'


_SUSPICIOUS = _wrong_value_pattern()


def is_sound(text: str, doc: str) -> Column:
    """True when the payload text fits the schema; takes the names of both columns."""
    # parsed as an object member for doc, as an array element here: a text with
    # something behind its first value fails one of the two
    single = F.json_array_length(F.concat(F.lit("["), F.col(text), F.lit("]"))) == 1
    plain = F.coalesce(F.col(f"{doc}.{_CORRUPT}").isNull() & single, F.lit(False))
    suspicious = F.rlike(F.col(text), F.lit(_SUSPICIOUS)) | F.contains(F.col(text), F.lit("\\u"))
    return F.when(~plain, False).when(~suspicious, True).otherwise(F.expr(_fits_sample(text)))


def plugin_name(doc: Column) -> Column:
    return F.coalesce(doc["sample"]["PluginName"], F.lit(""))


def event_name(doc: Column) -> Column:
    return F.coalesce(doc["sample"]["EventName"], F.lit(""))


def has_data(doc: Column) -> Column:
    return doc["sample"]["Data"].isNotNull()


def zero_of(dtype: T.DataType) -> Column:
    """What a missing field decodes to: empty text, zero, empty array."""
    if isinstance(dtype, T.StructType):
        return F.struct(*[zero_of(f.dataType).alias(f.name) for f in dtype])
    if isinstance(dtype, T.ArrayType):
        return F.array().cast(dtype)
    return F.lit("" if isinstance(dtype, T.StringType) else 0).cast(dtype)


def zero_stats() -> Column:
    return zero_of(STATS)


def _zero_sql(dtype: T.DataType) -> str:
    value = "array()" if isinstance(dtype, T.ArrayType) else "''" if isinstance(dtype, T.StringType) else "0"
    return f"cast({value} AS {dtype.simpleString()})"


def _filled(value: str, dtype: T.DataType, depth: int = 0) -> str:
    """SQL: ``value`` with every missing part, at any depth, replaced by its zero value."""
    if isinstance(dtype, T.StructType):
        return "struct(" + ", ".join(
            f"{_filled(f'{value}.{f.name}', f.dataType, depth)} AS {f.name}" for f in dtype) + ")"
    present = f"coalesce({value}, {_zero_sql(dtype)})"
    if isinstance(dtype, T.ArrayType):
        item = f"x{depth}"
        return f"transform({present}, {item} -> {_filled(item, dtype.elementType, depth + 1)})"
    return present


def decode_stats(doc: str = "doc") -> Column:
    """``Data`` as the stats struct; unknown keys dropped, absent keys zero, no ``Data`` NULL."""
    data = f"{doc}.sample.Data"
    return F.expr(f"CASE WHEN {data} IS NOT NULL THEN {_filled(data, STATS)} END")


def collect_ips(networks: Column) -> Column:
    """Addresses of all interfaces in order, duplicates kept."""
    return F.flatten(F.transform(
        F.coalesce(networks, F.array().cast(T.ArrayType(NIC))),
        lambda n: F.coalesce(n["ips"], F.array().cast("array<string>")),
    ))


def encode_event(plugin: Column, event: Column, data: Column) -> Column:
    """Event as JSON text; keys in wire order, missing data written as null."""
    return F.to_json(
        F.struct(plugin.alias("PluginName"), event.alias("EventName"), data.alias("Data")),
        {"ignoreNullFields": "false"},
    )


# --- nullable JSON columns -------------------------------------------------


def json_scan(text: Column, schema: T.StructType) -> Column:
    """Read a stored JSON column: NULL and empty text are no value, ``null`` is a zero value."""
    text = F.nullif(text, F.lit(""))
    return F.when(text.isNull(), None).when(F.trim(text) == "null", zero_of(schema)).otherwise(
        F.from_json(text, schema, STRICT_JSON))


def json_unmarshal(text: Column, schema: T.StructType) -> Column:
    """Read JSON inside a document: ``null`` is no value as well."""
    return F.when(text != "null", json_scan(text, schema))


def json_value(value: Column) -> Column:
    """Write a JSON column: no value stays NULL."""
    return F.when(value.isNotNull(), F.to_json(value, {"ignoreNullFields": "false"}))


def json_marshal(value: Column) -> Column:
    """Write JSON inside a document: no value is the text ``null``."""
    return F.coalesce(json_value(value), F.lit("null"))


def encode_service_info(info: Column) -> Column:
    """Service record as JSON: the two endpoints are left out when NULL, other NULLs kept."""
    names = [f.name for f in SERVICE_INFO]

    def text(keep: list[str]) -> Column:
        return F.to_json(F.struct(*[info[n].alias(n) for n in keep]), {"ignoreNullFields": "false"})

    def without(*drop: str) -> Column:
        return text([n for n in names if n not in drop])

    listen, probe = info["listen_address"].isNull(), info["probe_endpoint"].isNull()
    return (
        F.when(listen & probe, without("listen_address", "probe_endpoint"))
        .when(listen, without("listen_address"))
        .when(probe, without("probe_endpoint"))
        .otherwise(without())
    )


def decode_service_info(text: Column) -> Column:
    return F.from_json(text, SERVICE_INFO, STRICT_JSON)
