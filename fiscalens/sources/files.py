"""Readers by name, and sinks that a rerun leaves as they are."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from json import dumps, loads

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.normalize import quantity
from ..functions.storage import written
from .pages import pages, parsed

READERS: dict[str, Callable[..., DataFrame]] = {}

# The columns of the company registry's headerless files, in their order.
COMPANIES = ["cnpj_basico", "razao_social", "natureza_juridica", "qualificacao_responsavel", "capital_social", "porte_empresa", "ente_federativo"]
ESTABLISHMENTS = [
    "cnpj_basico", "cnpj_ordem", "cnpj_dv", "identificador_matriz_filial", "nome_fantasia", "situacao_cadastral", "data_situacao_cadastral", "motivo_situacao_cadastral", "nome_cidade_exterior", "pais",
    "data_inicio_atividade", "cnae_fiscal_principal", "cnae_fiscal_secundaria", "tipo_logradouro", "logradouro", "numero", "complemento", "bairro", "cep", "uf", "municipio", "ddd1", "telefone1", "ddd2", "telefone2",
    "ddd_fax", "fax", "correio_eletronico", "situacao_especial", "data_situacao_especial",
]
PARTNERS = ["cnpj_basico", "identificador_socio", "nome_socio_razao_social", "cnpj_cpf_socio", "qualificacao_socio", "data_entrada_sociedade", "pais", "representante_legal", "nome_representante", "qualificacao_representante_legal", "faixa_etaria"]
MUNICIPALITIES = ["tom_code", "nome"]


def reader(name: str):
    def put(f):
        READERS[name] = f
        return f

    return put


def read(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    if name not in READERS:
        raise KeyError(f"no source named {name}; known: {', '.join(sorted(READERS))}")
    return READERS[name](spark, path, **options)


@reader("parquet")
def parquet(spark, path, **options):
    return spark.read.options(**options).parquet(path)


@reader("json")
def json(spark, path, schema=None, **options):
    return (spark.read.schema(schema) if schema else spark.read).options(**options).json(path)


@reader("registry_dump")
def registry_dump(spark, path, columns: list[str]):
    """Headerless latin-1 files, ';' between fields, all strings."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).options(sep=";", encoding="ISO-8859-1", quote='"').csv(path)


#: Of a file's name: what its rows are, and the columns of the headerless ones.
ENTITIES = {"empresas": ("companies", COMPANIES), "estabelecimentos": ("establishments", ESTABLISHMENTS), "socios": ("partners", PARTNERS), "municipios": ("registry_municipalities", MUNICIPALITIES)}
ELECTION_ENTITIES = {"receitas_candidatos": "campaign_donations", "consulta_cand": "candidacies"}


def entity_of(name: str) -> str | None:
    """What the rows of a dump's file are, by the file's name; None for a file that is none of the known ones."""
    low = name.rsplit("/", 1)[-1].lower()
    for prefix, (entity, _) in ENTITIES.items():
        if low.startswith(prefix):
            return entity
    for prefix, entity in ELECTION_ENTITIES.items():
        if re.search(rf"{prefix}_\d{{4}}", low):
            return entity
    return None


def file_paths(spark: SparkSession, path: str, glob: str = "*") -> list[str]:
    """Paths of the files under a folder, without their contents. Dumps are some dozens of files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return sorted(r.path for r in found.select("path").collect())


def registry_files(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The dump's files under a folder by entity."""
    found: dict[str, list[str]] = {}
    for x in file_paths(spark, path):
        if (entity := entity_of(x)) is not None:
            found.setdefault(entity, []).append(x)
    columns = dict(ENTITIES.values())
    return {entity: registry_dump(spark, paths, columns[entity]) for entity, paths in found.items() if entity in columns}


@reader("election_dump")
def election_dump(spark, path):
    """Latin-1 files with a header; the year is that of the file's name. Where a year has a file of the whole country, those of the states
    are its parts and are left out."""
    kind = lambda x: re.match(r"(.*_\d{4})_(.+)\.csv$", x.rsplit("/", 1)[-1], re.IGNORECASE)
    files_ = [(m.group(1).lower(), m.group(2).upper(), x) for x in file_paths(spark, path, "*.csv") if (m := kind(x))]
    whole = {k for k, part, _ in files_ if part == "BRASIL"}
    chosen = [x for k, part, x in files_ if part == "BRASIL" or k not in whole]
    rows = spark.read.options(header=True, sep=";", encoding="ISO-8859-1").csv(chosen)
    return rows.withColumn("election_year", F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), r"_(\d{4})_", 1).try_cast("int"))


@reader("pod_listing")
def pod_listing(spark, path):
    """Lines of a listing of pods (namespace, pod, cpu, memory) with their use: pod, cpu_millicores, memory_bytes; other lines are left out."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(part.alias("p")).where("size(p) >= 3")
    at = lambda back: F.element_at("p", -back)
    return rows.select(at(3).alias("pod"), (quantity(at(2)) * 1000).alias("cpu_millicores"), quantity(at(1)).alias("memory_bytes")).where("cpu_millicores is not null and memory_bytes is not null")


CONTRACT_RECORD = (
    "numeroControlePNCP string, numeroContratoEmpenho string, sequencialCompra string, sequencial string, anoCompra string, anoContrato string, processo string, numeroCompra string, objetoCompra string, objetoContrato string, "
    "valorInicial string, valorInicialCompra string, valorGlobal string, valorAcumulado string, valorTotalHomologado string, dataAssinatura string, dataPublicacaoPncp string, dataAberturaProposta string, dataEncerramentoProposta string, "
    "dataVigenciaInicio string, dataVigenciaFim string, numeroRetificacao string, modalidadeId int, modalidadeNome string, situacaoCompraId int, situacaoCompraNome string, niFornecedor string, nomeRazaoSocialFornecedor string, tipoContrato struct<nome:string>, "
    "orgaoEntidade struct<cnpj:string,razaosocial:string,esferaId:string>, unidadeOrgao struct<codigoUnidade:string,nomeUnidade:string,ufSigla:string,municipioNome:string>, fornecedor struct<cnpj:string,cnpjFormatado:string,cpf:string,cpfFormatado:string,ni:string,razaoSocial:string,nome:string,uf:string,municipio:string>"
)
SANCTION_RECORD = (
    "id long, sancionado struct<codigoFormatado:string,nome:string>, pessoa struct<cnpjFormatado:string,cpfFormatado:string,razaoSocialReceita:string,nome:string>, orgaoSancionador struct<siglaUf:string,nome:string>, "
    "tipoSancao struct<descricaoPortal:string,descricaoResumida:string>, fundamentacao array<struct<descricao:string>>, numeroProcesso string, dataInicioSancao string, dataFimSancao string, dataPublicacaoSancao string, valorMulta string"
)
EXPULSION_RECORD = (
    "id long, punicao struct<nomePunido:string,cpfPunidoFormatado:string,processo:string>, pessoa struct<nome:string,cpfFormatado:string>, orgaoLotacao struct<nome:string>, ufLotacaoPessoa struct<uf:struct<sigla:string>>, tipoPunicao struct<descricao:string>, "
    "fundamentacao array<struct<descricao:string>>, dataPublicacao string"
)
_BODY = "codigo:string,codigoSIAFI:string,nome:string,razaoSocial:string"
_AGENCY = f"struct<{_BODY},descricaoPoder:string,esfera:string,esferaId:string,ufSigla:string,uf:string,municipioNome:string,municipio:string,orgaoVinculado:struct<{_BODY}>,orgaoMaximo:struct<{_BODY}>>"
_SUPPLIER = "struct<cnpj:string,cnpjFormatado:string,cpf:string,cpfFormatado:string,ni:string,razaoSocial:string,nome:string,uf:string,municipio:string>"
TRANSPARENCY_RECORD = (
    "id long, numero string, numeroContrato string, numeroProcesso string, objeto string, objetoContrato string, valorInicial string, valorGlobal string, valorInicialCompra string, valor string, dataAssinatura string, dataPublicacao string, "
    "dataVigenciaInicio string, dataVigenciaFim string, modalidade string, modalidadeNome string, situacao string, situacaoContrato string, anoContrato string, sequencial string, niFornecedor string, nomeFornecedor string, "
    f"unidadeGestora {_AGENCY}, unidadeGestoraCompras {_AGENCY}, orgao {_AGENCY}, fornecedor {_SUPPLIER}, contratado {_SUPPLIER}, fornecedores array<{_SUPPLIER}>"
)
TERM_RECORD = "numeroControlePNCP string, tipoTermoContratoNome string, qualificacaoAcrescimoSupressao boolean, qualificacaoVigencia boolean, valorAcrescido string, prazoAditadoDias string"


def one_supplier(df: DataFrame) -> DataFrame:
    """The supplier whatever the source calls it; the first where it gives a list."""
    if "fornecedores" not in df.columns:
        return df
    return df.withColumn("fornecedor", F.coalesce("fornecedor", "contratado", F.get("fornecedores", 0))).drop("contratado", "fornecedores")


def _landed(name: str, schema: str) -> None:
    """A source whose records lie as JSON lines, packed or not, by day or page; with _pages behind the name, as a paged source gives them."""
    def scan(spark, path, **options):
        return one_supplier(spark.read.options(**({"recursiveFileLookup": "true"} | options)).schema(schema).json(path))

    def paged(spark, path, **options):
        return one_supplier(parsed(pages(spark, path, **options), schema))

    READERS[name], READERS[f"{name}_pages"] = scan, paged


for _name, _schema in {"pncp": CONTRACT_RECORD, "pncp_contract_updates": CONTRACT_RECORD, "pncp_contract_terms": TERM_RECORD, "transparency": TRANSPARENCY_RECORD, "purchases": TRANSPARENCY_RECORD, "ceis": SANCTION_RECORD, "cnep": SANCTION_RECORD, "ceaf": EXPULSION_RECORD, "pod_usage": "pod string, cpu_millicores double, memory_bytes double"}.items():
    _landed(_name, _schema)


@reader("mock_pncp")
def mock_pncp(spark, path=None):
    """One record of the national portal, for trying a pipeline out."""
    one = '{"numeroControlePNCP": "10572048000128-1-000007/2024", "objetoCompra": "Supply of school meals", "valorTotalHomologado": "150000.50", "dataPublicacaoPncp": "2024-03-05T10:00:00", "modalidadeId": 6, "orgaoEntidade": {"cnpj": "10572048000128", "esferaId": "M"}, "unidadeOrgao": {"codigoUnidade": "2531", "nomeUnidade": "City hall", "ufSigla": "PE", "municipioNome": "Recife"}, "fornecedor": {"cnpj": "12345678000190", "razaoSocial": "Foods Ltda"}}'
    return spark.createDataFrame([(one,)], "value string").select(F.from_json("value", CONTRACT_RECORD).alias("r")).select("r.*")


@reader("mock_transparency")
def mock_transparency(spark, path=None):
    return spark.createDataFrame([(1, "Cleaning", "1000,00", "2024-01-10", ("26000", "Ministry"), ("12.345.678/0001-90", "Cleaners SA"))], "id long, objeto string, valorInicial string, dataAssinatura string, unidadeGestora struct<codigo:string,nome:string>, fornecedor struct<cnpjFormatado:string,nome:string>")


@reader("gazettes")
def gazettes(spark, path):
    """Whole texts; territory, date and digest are those of names like 1234567-2020-01-31-0123456789ab.txt."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    part = lambda k: F.nullif(F.regexp_extract(name, r"^(\d{7})-(\d{4}-\d{2}-\d{2})-([0-9a-f]{12})\.txt$", k), F.lit(""))
    return spark.read.text(path, wholetext=True).select(part(1).alias("territory_id"), part(2).try_cast("date").alias("date"), part(3).alias("digest"), F.col("value").alias("text"))


READERS |= {"federal_revenue": registry_dump, "tse": election_dump, "querido_diario": gazettes}


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Only the partitions that df has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.schema("number long, version string, _bucket int, buckets int, schema string").parquet(f"{path}/commits") if exists(spark, f"{path}/commits") else None


def current(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table that upserts made at ``path``, as of the last commit, or as of an earlier one's number. A DataFrame once read stays as it
    was, whatever is committed after it."""
    commits = _commits(spark, path)
    if commits is None:
        raise FileNotFoundError(f"no table at {path}")
    if number is not None:
        commits = commits.where(F.col("number") <= number)
    latest = commits.groupBy("_bucket").agg(F.max_by("version", "number").alias("version")).collect()  # a row a bucket
    schema = commits.agg(F.max_by("schema", "number")).first()[0]
    if schema is None:
        raise ValueError(f"no commit up to {number}")
    by_version: dict[str, list[int]] = {}
    for r in latest:
        by_version.setdefault(r.version, []).append(r["_bucket"])
    rows = spark.read.schema(StructType.fromJson(loads(schema)).add("version", "string").add("_bucket", "integer")).parquet(f"{path}/data")
    chosen = F.lit(False)
    for version, buckets in sorted(by_version.items()):
        chosen |= (F.col("version") == version) & F.col("_bucket").isin(sorted(buckets))
    return rows.where(chosen).drop("version", "_bucket")


def upsert(spark: SparkSession, df: DataFrame, path: str, key: str, buckets: int = 64) -> int:
    """df's rows into the table at ``path``, in place of those of the same key; ``current`` reads it. Gives the number of the commit.

    Buckets of the key that df touches are written anew, beside the old ones, in a folder of this version; then one small file commits it.
    A failure at any step, the last one too, leaves the table as it was, and readers see either version whole. One writer at a time. The
    number of buckets is that of the first commit. Of several rows of df with one key the largest stays; NULL is a key like others; columns
    that df lacks are NULL in its rows, and new ones are added. Old versions stay, for readers that have them open, until ``vacuum``.
    """
    commits, old, number = _commits(spark, path), None, 0
    if commits is not None:
        known = commits.agg(F.max("number").alias("number"), F.max("buckets").alias("buckets")).first()
        number, buckets, old = known.number + 1, known.buckets, current(spark, path)
    in_bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rest = [c for c in df.columns if c != key]
    new = df.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, "_r.*") if rest else df.distinct()
    new = written(new.select(*df.columns).withColumn("_bucket", in_bucket), "upsert-new")
    touched = sorted(r["_bucket"] for r in new.select("_bucket").distinct().collect())  # buckets at most
    merged = new
    if old is not None:
        same = F.col(f"_old.{key}").eqNullSafe(F.col(f"_new.{key}"))
        kept = old.withColumn("_bucket", in_bucket).where(F.col("_bucket").isin(touched)).alias("_old").join(new.select(key).alias("_new"), same, "left_anti")
        merged = kept.unionByName(new, allowMissingColumns=True)
    version = f"{number:010d}-{uuid.uuid4().hex}"
    schema = dumps(merged.drop("_bucket").schema.jsonValue())
    merged.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version", "_bucket").parquet(f"{path}/data")
    rows = [(number, version, b, buckets, schema) for b in touched] or [(number, version, 0, buckets, schema)] * (old is None)
    if rows:
        spark.createDataFrame(rows, "number long, version string, _bucket int, buckets int, schema string").coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return number if rows else number - 1


def history(spark: SparkSession, path: str) -> DataFrame:
    """A table's commits: number, touched (buckets written)."""
    return _commits(spark, path).groupBy("number").agg(F.count(F.lit(1)).alias("touched"))


def vacuum(spark: SparkSession, path: str, to: str) -> None:
    """The table as it stands as a new one at ``to``, of one version; the old folder can go when nobody reads it."""
    commits = _commits(spark, path)
    buckets = commits.agg(F.max("buckets")).first()[0]
    rows = current(spark, path)
    keyless = commits.groupBy("_bucket").agg(F.max_by("version", "number").alias("version"))
    data = spark.read.schema(rows.schema.add("version", "string").add("_bucket", "integer")).parquet(f"{path}/data").join(F.broadcast(keyless), ["version", "_bucket"], "left_semi")
    version = f"{0:010d}-{uuid.uuid4().hex}"
    data.drop("version").withColumn("version", F.lit(version)).write.mode("append").partitionBy("version", "_bucket").parquet(f"{to}/data")
    schema = dumps(rows.schema.jsonValue())
    keyless.select(F.lit(0).cast("long").alias("number"), F.lit(version).alias("version"), "_bucket", F.lit(buckets).alias("buckets"), F.lit(schema).alias("schema")).coalesce(1).write.mode("append").parquet(f"{to}/commits")


def append(df: DataFrame, path: str, *keys: str) -> None:
    """Rows added to a table, by partition if keys are given."""
    writer = df.write.mode("append")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def write_bronze(df: DataFrame, path: str, source: str, dt: str) -> str:
    """A day's raw records as packed JSON lines; a rerun of the day replaces it."""
    out = f"{path}/{source}/dt={dt}"
    df.write.mode("overwrite").option("compression", "gzip").json(out)
    return out


def list_bronze(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Files of a source: path, dt, bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!._]*").load(f"{path}/{source}")
    return found.select("path", F.nullif(F.regexp_extract("path", r"/dt=([^/]+)/", 1), F.lit("")).alias("dt"), F.col("length").alias("bytes"))


def pending(wanted: DataFrame, path: str, key: str) -> DataFrame:
    """What of the wanted keys the checkpoint table at ``path`` does not have yet."""
    spark = wanted.sparkSession
    return wanted.join(spark.read.parquet(path).select(key), key, "left_anti") if exists(spark, path) else wanted


def checkpoint_terms(wanted: DataFrame, fetched: DataFrame, path: str) -> None:
    """The answers (id, terms) for contracts that have none yet; a contract without terms keeps an empty array, so that it is not asked again."""
    todo = pending(wanted.select("id").distinct(), path, "id")
    append(todo.join(fetched.select("id", "terms"), "id", "inner").select("id", F.coalesce("terms", F.lit("[]")).alias("terms")), path)


def append_absent(spark: SparkSession, df: DataFrame, path: str, key: str) -> None:
    df.join(spark.read.parquet(path).select(key), key, "left_anti").write.mode("append").parquet(path)


# The names of the marts that may be published and of those that may not; why is what each holds here.
PUBLIC = {
    "contracts_by_agency": "a row an agency: counts and sums of its contracts", "contracts_daily": "a row a day: counts and sums of all contracts", "supplier_stats": "a row a supplier, under the number that the portals print",
    "amendments_by_agency": "a row an agency: how many of its contracts were raised or prolonged", "amendments_by_supplier": "a row a supplier: how many of its contracts were raised or prolonged", "contract_amendments": "a row a contract: first and last values and terms, nobody named",
    "red_flags_by_agency": "a row an agency: shares of flagged contracts", "red_flags_by_supplier": "a row a supplier: shares of flagged contracts", "political_connections": "a row a donor and candidate, a person's number with its ends hidden",
}
INTERNAL = {"pod_usage_hourly": "how busy our machines were", "platform_cost_daily": "what our machines cost", "data_quality_daily": "how complete each day's load was", "contract_red_flags": "single contracts, of persons too"}


def classify(marts: list[str]) -> tuple[list[str], list[str]]:
    """(those that may be published, those that nobody has classified)."""
    return [m for m in PUBLIC if m in marts], [m for m in marts if m not in PUBLIC and m not in INTERNAL]


def export(df: DataFrame, name: str, path: str, run_date: str) -> DataFrame:
    """An allowed mart as CSV and as Parquet of strings, and a manifest of the files (mart, run_date, format, file, bytes, sha256, rows,
    columns, reason) beside them; any other name raises before a byte is written."""
    if name not in PUBLIC:
        raise PermissionError(f"{name} is not public")
    spark, out = df.sparkSession, f"{path}/{name}/dt={run_date}"
    text = written(df.select(*[F.col(c).cast("string") for c in df.columns]), "export")
    text.write.mode("overwrite").option("header", True).csv(f"{out}/csv")
    text.write.mode("overwrite").parquet(f"{out}/parquet")
    rows = text.count()
    files_ = [spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{out}/{kind}").withColumn("format", F.lit(kind)) for kind in ("csv", "parquet")]
    manifest = files_[0].unionByName(files_[1]).select(F.lit(name).alias("mart"), F.lit(run_date).alias("run_date"), "format", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.lit(rows).cast("long").alias("rows"), F.lit(",".join(df.columns)).alias("columns"), F.lit(PUBLIC[name]).alias("reason"))
    manifest = written(manifest, "manifest")
    manifest.write.mode("overwrite").json(f"{out}/manifest")
    return manifest


def serve(df: DataFrame, path: str, *keys: str) -> None:
    """A mart's copy for serving, sorted by its keys within files, so that a reader skips what it does not ask for; replaced as a whole."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def store_evidence(df: DataFrame, path: str) -> DataFrame:
    """Contents (type, source, captured_on, extension, content, metadata: a map) under the hash of their bytes: what is there already is not
    stored again. Gives key, sha256, bytes and metadata of all of df. A content without bytes or type raises."""
    spark = df.sparkSession
    bad = df.where("content is null or length(content) = 0 or type is null or source is null or captured_on is null").limit(1).count()
    if bad:
        raise ValueError("evidence needs content, type, source and a day")
    digest = F.sha2("content", 256)
    key = F.concat_ws("/", F.lit("evidence"), "type", "source", F.date_format("captured_on", "yyyy"), F.date_format("captured_on", "MM"), F.concat(digest, F.lit("."), F.coalesce("extension", F.lit("bin"))))
    rows = written(df.select(key.alias("key"), digest.alias("sha256"), F.octet_length("content").cast("long").alias("bytes"), "type", "source", "metadata", "content"), "evidence")
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("sha256"))).where("_n = 1").drop("_n")
    append(pending(first, path, "key"), path, "type")
    return rows.select("key", "sha256", "bytes", "metadata")


def find_evidence(spark: SparkSession, path: str, **metadata: str) -> DataFrame:
    """Stored evidence whose metadata has these values, without the contents."""
    found = spark.read.parquet(path).drop("content")
    for name, value in metadata.items():
        found = found.where(F.col("metadata")[name] == value)
    return found
