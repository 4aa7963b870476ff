"""JSON-shaped and line-shaped configuration → runtime, resource and script rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import file_name
from .manifests import plain_json

_BINDING = "array<struct<binding:string,database_name:string,database_id:string,id:string,bucket_name:string,service:string>>"
_WORKER = f"name string, main string, account_id string, d1_databases {_BINDING}, kv_namespaces {_BINDING}, r2_buckets {_BINDING}, services {_BINDING}"
# Binding sections of a worker config and the resource types they stand for.
BINDING_TYPES = {"d1_databases": "D1", "kv_namespaces": "KV", "r2_buckets": "R2", "services": "Service binding"}
# Emulated services and their default ports.
EMULATORS = {"auth": 9099, "functions": 5001, "firestore": 8080, "database": 9000, "hosting": 5000, "pubsub": 8085, "storage": 9199, "eventarc": 9299, "dataconnect": 9399}
CI_RESERVED = ("stages", "variables", "default", "include", "workflow", "image", "services", "cache", "before_script", "after_script", "pages")
_COLUMNS = {
    "resource": ("type", "binding", "identifier", "account", "environment", "endpoint"),
    "runtime": ("environment", "name", "main"),
    "job": ("job", "seq", "command"),
    "need": ("job", "needs"),
}
_FIELDS = ("type", "binding", "identifier", "account", "environment", "endpoint", "name", "main", "job", "command", "needs")
_FACT = "struct<fact:string,seq:int," + ",".join(f"{name}:string" for name in _FIELDS) + ">"


def _fact(fact: str, seq: Column | None = None, **values: Column) -> Column:
    text = lambda name: values.get(name, F.lit(None)).cast("string").alias(name)
    return F.struct(F.lit(fact).alias("fact"), (F.lit(None) if seq is None else seq).cast("int").alias("seq"), *[text(name) for name in _FIELDS])


def _none() -> Column:
    return F.array().cast(f"array<{_FACT}>")


def _or_none(facts: Column) -> Column:
    return F.coalesce(facts, _none())


def _found(text: Column, rule: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rule), F.lit(1))


def _worker(w: Column) -> Column:
    """Runtimes and bindings of the default and the named environments of a worker."""

    def of(s: Column, environment: Column, account: Column) -> Column:
        arrays = [F.when(s["name"].isNotNull() | s["main"].isNotNull(), F.array(_fact("runtime", environment=environment, name=s["name"], main=s["main"]))).otherwise(_none())]
        for section, kind in BINDING_TYPES.items():
            key = {"D1": "database_id", "KV": "id", "R2": "bucket_name", "Service binding": "service"}[kind]
            arrays.append(_or_none(F.transform(s[section], _binding(kind, key, environment, account))))
        return F.concat(*arrays)

    nested = F.flatten(F.transform(F.map_entries(w["env"]), lambda e: of(e["value"], e["key"], F.coalesce(e["value"]["account_id"], w["account_id"]))))
    return F.concat(of(w, F.lit("default"), w["account_id"]), _or_none(nested))


def _binding(kind: str, key: str, environment: Column, account: Column):
    return lambda b: _fact("resource", type=F.lit(kind), binding=F.coalesce(b["binding"], b["database_name"]), identifier=b[key], account=account, environment=environment)


def _firebase(j: Column) -> Column:
    ports = F.create_map(*[F.lit(str(item)) for pair in EMULATORS.items() for item in pair])
    emulated = F.map_entries(F.from_json(F.get_json_object(j, "$.emulators"), "map<string,struct<host:string,port:string>>"))
    address = lambda e: F.concat(F.lit("http://"), F.coalesce(e["value"]["host"], F.lit("127.0.0.1")), F.lit(":"), F.coalesce(e["value"]["port"], F.element_at(ports, e["key"])))
    emulators = F.transform(F.filter(emulated, lambda e: e["key"].isin(*EMULATORS)), lambda e: _fact("resource", type=F.lit("emulator"), binding=e["key"], environment=F.lit("local"), endpoint=address(e)))
    hosting = F.get_json_object(j, "$.hosting")
    sites = F.when(hosting.rlike(r"^\s*\["), F.from_json(hosting, "array<struct<target:string,site:string,public:string>>")).when(hosting.isNotNull(), F.array(F.from_json(hosting, "target string, site string, public string")))
    label = lambda h, i: F.coalesce(h["target"], h["site"], F.concat(F.lit("hosting:"), i.cast("string")))
    hosted = F.transform(sites, lambda h, i: _fact("resource", type=F.lit("hosting"), binding=label(h, i), identifier=h["site"], environment=F.lit("cloud"), endpoint=h["public"]))
    return F.concat(_or_none(emulators), _or_none(hosted))


def _template(j: Column) -> Column:
    entries = F.filter(F.map_entries(F.from_json(F.get_json_object(j, "$.Resources"), "map<string,string>")), lambda e: F.get_json_object(e["value"], "$.Type") == "AWS::CloudFront::Distribution")
    origins = lambda e: F.from_json(F.get_json_object(e["value"], "$.Properties.DistributionConfig.Origins"), "array<struct<Id:string,DomainName:string>>")
    row = lambda e, o: _fact("resource", type=F.lit("cdn-distribution"), binding=e["key"], identifier=o["Id"], environment=F.lit("cloud"), endpoint=o["DomainName"])
    none = F.array(F.struct(F.lit(None).cast("string").alias("Id"), F.lit(None).cast("string").alias("DomainName")))
    listed = lambda e: F.when(F.size(F.coalesce(origins(e), F.array().cast("array<struct<Id:string,DomainName:string>>"))) > 0, origins(e)).otherwise(none)
    return _or_none(F.flatten(F.transform(entries, lambda e: F.transform(listed(e), lambda o: row(e, o)))))


def _proxy(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?m)#[^\n]*$", "")
    configured = F.lit("configured")
    passed = F.transform(_found(text, r"\bproxy_pass\s+([^;\s]+)\s*;"), lambda target: _fact("resource", type=F.lit("proxy-pass"), binding=F.regexp_extract(target, r"^[a-z]+://([^/:]+)", 1), environment=configured, endpoint=target))
    group = lambda u: F.regexp_extract(u, r"^upstream\s+([\w.-]+)", 1)
    servers = F.flatten(
        F.transform(_found(text, r"\b(upstream\s+[\w.-]+\s*\{[^}]*\})"), lambda u: F.transform(_found(u, r"\bserver\s+([^;\s]+)"), lambda server: _fact("resource", type=F.lit("upstream-server"), binding=group(u), environment=configured, endpoint=server)))
    )
    return F.concat(passed, servers)


def _ci(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?m)^[ \t]*#[^\n]*$\n?", "")
    blocks = _found(text, r"(?m)(^[A-Za-z_.][^\s:#][^:\n]*:[ \t]*\r?\n(?:[ \t]++[^\n]*+(?:\n|$)|\r?\n)++)")
    job = lambda b: F.trim(F.regexp_extract(b, r"^([^:\n]+):", 1))
    kept = F.filter(blocks, lambda b: ~job(b).isin(*CI_RESERVED) & ~job(b).startswith("."))
    script = lambda b: F.regexp_extract(b, r"(?m)^[ \t]+script:[ \t]*\r?\n((?:[ \t]++-[^\n]*+(?:\n|$))++)", 1)
    commands = F.flatten(F.transform(kept, lambda b: F.transform(_found(script(b), r"(?m)^[ \t]+-\s*(.+?)\s*$"), lambda line, i: _fact("job", job=job(b), seq=i, command=line))))
    named = lambda b: F.transform(F.split(F.regexp_extract(b, r"(?m)^[ \t]+needs:[ \t]*\[([^\]]*)\]", 1), r"\s*,\s*"), lambda n: F.regexp_replace(F.trim(n), r"^[\"']|[\"']$", ""))
    needs = F.flatten(F.transform(kept, lambda b: F.transform(F.filter(named(b), lambda n: n != ""), lambda n: _fact("need", job=job(b), needs=n))))
    return F.concat(commands, needs)


def config_facts(files: DataFrame) -> DataFrame:
    """All rows of the configurations of ``files`` in one pass: ``project_id``, ``path``, ``fact`` and its columns.

    Each file is read by the expression of its kind; its rows are one array, exploded once.
    """
    if "project_id" not in files.columns:
        files = files.withColumn("project_id", F.lit(""))
    name = F.lower(file_name("path"))
    form = (
        F.when(name.rlike(r"^wrangler\.jsonc?$"), "worker").when(name == "firebase.json", "firebase").when(name == "nginx.conf", "proxy").when(name == ".gitlab-ci.yml", "ci")
        .when(name.endswith(".json") & F.contains("text", F.lit("AWS::CloudFront::Distribution")), "template")
    )
    named = name.rlike(r"^wrangler\.jsonc?$|^nginx\.conf$|^\.gitlab-ci\.yml$|\.json$")
    found = files.filter(named).select("project_id", "path", form.alias("form"), F.col("text")).filter("form is not null")
    json = F.col("form").isin("worker", "firebase", "template")
    found = found.withColumn("text", F.when(json, plain_json("text")).otherwise(F.col("text")))
    found = found.withColumn("_worker", F.when(F.col("form") == "worker", F.from_json("text", f"{_WORKER}, env map<string,struct<{_struct(_WORKER)}>>")))
    text = F.col("text")
    rows = F.when(F.col("form") == "worker", _worker(F.col("_worker"))).when(F.col("form") == "firebase", _firebase(text)).when(F.col("form") == "template", _template(text)).when(F.col("form") == "proxy", _proxy(text)).otherwise(_ci(text))
    return found.select("project_id", "path", F.explode(_or_none(rows)).alias("r")).select("project_id", "path", "r.*")


def config_resources(files: DataFrame) -> dict[str, DataFrame]:
    """``resource`` (``path``, ``type``, ``binding``, ``identifier``, ``account``, ``environment``, ``endpoint``), ``runtime``
    (``path``, ``name``, ``main``), ``job`` (``path``, ``job``, ``command``, ``seq``) and ``need`` (``path``, ``job``, ``needs``).

    All are parts of :func:`config_facts`; who needs several stores it once."""
    facts = config_facts(files)
    return {fact: facts.filter(F.col("fact") == fact).select("project_id", "path", *columns) for fact, columns in _COLUMNS.items()}


def _struct(fields: str) -> str:
    """``a string, b int`` as the inside of a struct type."""
    depth, pieces, start = 0, [], 0
    for i, ch in enumerate(fields):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            pieces.append(fields[start:i])
            start = i + 1
    pieces.append(fields[start:])
    return ",".join(piece.strip().replace(" ", ":", 1) for piece in pieces)
