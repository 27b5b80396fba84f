"""Random payloads against a plain model of the decoder's rules."""

import json
import random

from pyspark.sql import functions as F
from test_payload import envelopes

from hostloom.operators import ingest as I
from hostloom.functions.payload import NESTED_KEYS
from hostloom.schemas import COUNTER_FIELDS, UINT64_MAX

TEXTS = ("uptime", "hostname", "os", "arch", "kernel")


class Bad(ValueError):
    pass


def need(ok):
    if not ok:
        raise Bad


def is_number(v):
    return v is None or (isinstance(v, (int, float)) and not isinstance(v, bool) and abs(v) < 1e308)


KNOWN = {k.lower(): k for k in ("PluginName", "EventName", "Data", *NESTED_KEYS)}


def by_any_case(pairs):
    return {KNOWN.get(k.lower(), k): v for k, v in pairs}


def is_text(v):
    return v is None or isinstance(v, str)


def check_object(v, rules):
    need(v is None or isinstance(v, dict))
    for key, rule in rules.items():
        need(rule((v or {}).get(key)))


def check_list(v, rule):
    need(v is None or isinstance(v, list))
    for item in v or []:
        rule(item)
    return True


def is_uint64(v):
    return v is None or (isinstance(v, int) and not isinstance(v, bool) and 0 <= v <= UINT64_MAX)


def check_disk(v):
    check_object(v, {"mountpoint": is_text, "used_percent": is_number})


def check_nic(v):
    def texts(x):
        return check_list(x, lambda i: need(is_text(i)))
    check_object(v, {"mac": is_text, "if_name": is_text, "ips": texts, **dict.fromkeys(COUNTER_FIELDS, is_uint64)})


def check_data(v):
    check_object(v, {
        "cpu": is_number, "memory": is_number, **dict.fromkeys(TEXTS, is_text),
        "disk": lambda x: check_list(x, check_disk), "networks": lambda x: check_list(x, check_nic)})
    return True


def refuse(name):
    raise Bad(name)


def model(text, client="c"):
    if not text:
        return I.EMPTY_PAYLOAD
    try:
        doc = json.loads(text, parse_constant=refuse, object_pairs_hook=by_any_case)
        check_object(doc, {"PluginName": is_text, "EventName": is_text, "Data": check_data})
    except (ValueError, RecursionError):
        return I.MALFORMED
    doc = doc or {}
    if doc.get("PluginName") != "host":
        return I.OTHER_PLUGIN
    return I.NULL_DATA if doc.get("Data") is None else None


def any_value(rng, depth=0):
    simple = [None, True, 0, 7, -3, 2.5, 1e30, 10**19, UINT64_MAX, UINT64_MAX + 1, "", "text", 'q"uo:te', "é\n", "1"]
    if depth < 2 and rng.random() < 0.3:
        return rng.choice([
            [any_value(rng, depth + 1) for _ in range(rng.randrange(3))],
            {rng.choice(["a", "hostname", "rx_bytes", "ips"]): any_value(rng, depth + 1)}])
    return rng.choice(simple)


def mostly(rng, good, odds=0.04):
    return any_value(rng) if rng.random() < odds else good


def sample(rng):
    def some(pairs):
        out = [(k, mostly(rng, v)) for k, v in pairs if rng.random() < 0.8]
        if rng.random() < 0.1:
            out.append((rng.choice(["extra", "zz"]), any_value(rng)))
        rng.shuffle(out)
        return dict(out)

    def nic():
        return some([("mac", "aa:01"), ("ips", [mostly(rng, "10.0.0.1", 0.02) for _ in range(rng.randrange(3))]),
                     ("if_name", "eth0"), *[(k, rng.choice([0, 5, 10**18, UINT64_MAX])) for k in COUNTER_FIELDS]])

    data = some([("cpu", 1.5), ("memory", 3), *[(k, "x") for k in TEXTS],
                 ("disk", [some([("mountpoint", "/"), ("used_percent", 9.5)]) for _ in range(rng.randrange(3))]),
                 ("networks", [nic() for _ in range(rng.randrange(3))])])
    return some([("PluginName", "host"), ("EventName", ""), ("Data", data)])


def payload(rng):
    text = json.dumps(sample(rng), ensure_ascii=rng.random() < 0.5,
                      separators=rng.choice([(",", ":"), (", ", ": "), (" ,\n", "\t: ")]))
    if rng.random() < 0.2:
        key = rng.choice(list(KNOWN.values()))
        text = text.replace(f'"{key}"', f'"{rng.choice([key.upper(), key.lower(), key.title()])}"')
    if rng.random() < 0.3:
        at = rng.randrange(len(text) + 1)
        text = rng.choice([
            text[:at] + rng.choice(list('{}[],:"0a \\')) + text[at:], text[:at] + text[at + 1:], text[:at],
            text + rng.choice(["}", "]", " x", ",1", ',"a":1', '],"a":[1', '}{', "\n"])])
    return text


def test_random_payloads(spark):
    rng = random.Random(11)
    texts = sorted({payload(rng) for _ in range(6000)})
    got = {r.p: r.reason for r in I.classified(envelopes(spark, texts)).select(
        F.col("payload").cast("string").alias("p"), "reason").collect()}
    wrong = [(t, got[t], model(t)) for t in texts if got[t] != model(t)]
    assert len(set(got.values())) >= 4
    assert not wrong, (len(wrong), wrong[:5])
