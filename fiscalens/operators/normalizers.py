"""Raw records of the sources as silver rows: contracts, sanctions, company registry, elections, municipalities.

Each function takes a DataFrame of raw records (fields as the source names them, nested as structs) and gives typed columns. A field that
the DataFrame does not have reads as NULL. What is empty falls through to the next name, as do NULL and the number 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType, StructType

from ..functions.normalize import date_of, decimal_br, digits, plain_text

MONEY = "decimal(38,4)"

# The sources' code tables.
LEVELS = {"F": "federal", "E": "state", "M": "municipal", "D": "district", "FEDERAL": "federal", "ESTADUAL": "state", "MUNICIPAL": "municipal", "DISTRITAL": "district"}
MODALITIES = {
    1: "leilao_eletronico", 2: "dialogo_competitivo", 3: "concurso", 4: "concorrencia_eletronica", 5: "concorrencia_presencial", 6: "pregao_eletronico", 7: "pregao_presencial",
    8: "dispensa", 9: "inexigibilidade", 10: "manifestacao_interesse", 11: "pre_qualificacao", 12: "credenciamento", 13: "leilao_presencial",
}
STATUSES = {1: "published", 2: "revoked", 3: "annulled", 4: "suspended"}
UFS = {
    "11": "RO", "12": "AC", "13": "AM", "14": "RR", "15": "PA", "16": "AP", "17": "TO", "21": "MA", "22": "PI", "23": "CE", "24": "RN", "25": "PB", "26": "PE", "27": "AL",
    "28": "SE", "29": "BA", "31": "MG", "32": "ES", "33": "RJ", "35": "SP", "41": "PR", "42": "SC", "43": "RS", "50": "MS", "51": "MT", "52": "GO", "53": "DF",
}
NO_INFORMATION = "sem informação"


def code(values: dict, of: Column) -> Column:
    return F.create_map(*[F.lit(str(x)) for pair in values.items() for x in pair])[of]


def field(df: DataFrame, *paths: str) -> Column:
    """The first of the fields at dotted paths that is filled, as a string; NULL if df has none of them."""
    found = []
    for path in paths:
        kind = df.schema
        for name in path.split("."):
            kind = kind[name].dataType if isinstance(kind, StructType) and name in kind.names else None
        if kind is not None:
            own = F.nullif(F.col(path).cast("string"), F.lit(""))
            found.append(F.when(F.col(path) != 0, own) if isinstance(kind, NumericType) else own)
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def decimal_of(x: Column) -> Column:
    """A number whose decimal sign may be a comma."""
    return F.replace(x, F.lit(","), F.lit(".")).try_cast(MONEY)


def contract_date(x: Column) -> Column:
    """ISO dates and times and DD/MM/YYYY, or else the first YYYY-MM-DD in the text."""
    return F.coalesce(date_of(F.trim(x)), F.nullif(F.regexp_extract(x, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")).try_cast("date"))


def level_of(x: Column) -> Column:
    return F.coalesce(code(LEVELS, F.upper(F.trim(x))), F.lit("federal"))


def supplier_of(df: DataFrame, nested: str, flat: dict[str, list[str]]) -> Column:
    """The supplier as a struct: its own record where there is one, else the flat fields of the contract."""
    number = F.coalesce(field(df, *[f"{nested}.{x}" for x in ("cnpj", "cnpjFormatado", "cpf", "cpfFormatado", "ni")]), field(df, *flat["cnpj"]), field(df, *flat["cpf"]))
    d = digits(number)
    name = F.coalesce(field(df, *[f"{nested}.{x}" for x in ("legal_name", "razaoSocial", "nome", "nomeRazaoSocial")]), field(df, *flat["name"]), F.lit("Supplier not informed"))
    return F.struct(F.when(F.length(d) == 14, d).alias("cnpj"), F.when(F.length(d) == 11, d).alias("cpf"), name.alias("legal_name"), field(df, f"{nested}.uf", f"{nested}.state").alias("state"), field(df, f"{nested}.municipio", f"{nested}.city").alias("city"))


FLAT_SUPPLIER = {"cnpj": ["niFornecedor", "cnpjFornecedor", "cnpjContratado"], "cpf": ["cpfFornecedor"], "name": ["nomeRazaoSocialFornecedor", "nomeFornecedor", "razaoSocialContratado"]}


def fallback_id(df: DataFrame) -> Column:
    parts = F.concat_ws("-", field(df, "orgaoEntidade.cnpj"), field(df, "anoCompra", "anoContrato"), field(df, "sequencialCompra", "sequencial"))
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit("unknown"))


def _contract(df: DataFrame, run_date: str | None, **c: Column) -> DataFrame:
    today = F.lit(run_date).cast("date") if run_date else F.current_date()
    signed = F.coalesce(c["signed"], today)
    start = F.coalesce(contract_date(field(df, "dataVigenciaInicio")), signed)
    end = F.coalesce(contract_date(field(df, "dataVigenciaFim")), start)
    return df.select(c["id"].alias("id"), c["process"].alias("process_number"), c["subject"].alias("subject"), F.coalesce(decimal_of(c["amount"]), F.lit(0).cast(MONEY)).alias("amount"), signed.alias("signature_date"), start.alias("validity_start"), end.alias("validity_end"),
                     c["buyer"].alias("buyer"), c["supplier"].alias("supplier"), F.lower(c["modality"]).alias("modality"), F.lower(c["status"]).alias("status"))


def contracts_from_pncp(df: DataFrame, run_date: str | None = None) -> DataFrame:
    """Contracts of the national portal, of publications and of contracts. ``run_date`` stands in where no date is given (today by default)."""
    f = lambda *p: field(df, *p)
    identity = F.coalesce(f("numeroControlePNCP", "numeroContratoEmpenho", "sequencialCompra"), fallback_id(df))
    buyer = F.struct(
        F.coalesce(f("unidadeOrgao.codigoUnidade", "orgaoEntidade.cnpj"), F.lit("")).alias("siafi_code"), F.coalesce(f("unidadeOrgao.nomeUnidade", "orgaoEntidade.razaosocial"), F.lit("Agency not informed")).alias("name"),
        level_of(f("orgaoEntidade.esferaId")).alias("government_level"), F.upper(F.substring(F.coalesce(f("unidadeOrgao.ufSigla"), F.lit("")), 1, 2)).alias("uf"), f("unidadeOrgao.municipioNome").alias("city"))
    return _contract(
        df, run_date, id=identity, process=F.coalesce(f("processo", "numeroContratoEmpenho", "numeroCompra"), identity), subject=F.coalesce(f("objetoCompra", "objetoContrato"), F.lit("Subject not informed")), amount=f("valorTotalHomologado", "valorGlobal", "valorInicialCompra"),
        signed=F.coalesce(*[contract_date(f(x)) for x in ("dataAssinatura", "dataPublicacaoPncp", "dataAberturaProposta")]), buyer=buyer, supplier=supplier_of(df, "fornecedor", FLAT_SUPPLIER),
        modality=F.coalesce(f("modalidadeNome", "tipoContrato.nome"), code(MODALITIES, f("modalidadeId")), F.lit("not_informed")), status=F.coalesce(f("situacaoCompraNome"), code(STATUSES, f("situacaoCompraId")), F.lit("published")))


def contracts_from_transparency(df: DataFrame, run_date: str | None = None) -> DataFrame:
    """Contracts of the transparency portal, with its other names; the status is completed by default."""
    f = lambda *p: field(df, *p)
    agencies = ("unidadeGestora", "unidadeGestoraCompras", "orgao", "orgaoEntidade", "orgaoContratante")
    of = lambda *names: f(*[f"{a}.{n}" for a in agencies for n in names])
    supplier = next((x for x in ("fornecedor", "contratado") if x in df.columns), None)
    if supplier is None and "fornecedores" in df.columns and isinstance(df.schema["fornecedores"].dataType, ArrayType):
        df, supplier = df.withColumn("_supplier", F.get("fornecedores", 0)), "_supplier"
    identity = F.coalesce(f("id", "numeroContrato", "numero"), fallback_id(df))
    buyer = F.struct(
        F.coalesce(of("codigo", "codigoSIAFI"), of("orgaoVinculado.codigo", "orgaoMaximo.codigo", "orgaoVinculado.codigoSIAFI", "orgaoMaximo.codigoSIAFI"), F.lit("")).alias("siafi_code"), F.coalesce(of("nome", "razaoSocial"), F.lit("Agency not informed")).alias("name"),
        level_of(of("descricaoPoder", "esfera", "esferaId")).alias("government_level"), F.upper(F.substring(F.coalesce(of("ufSigla", "uf"), F.lit("")), 1, 2)).alias("uf"), of("municipioNome", "municipio").alias("city"))
    return _contract(
        df, run_date, id=identity, process=F.coalesce(f("numeroProcesso", "numeroContrato"), identity), subject=F.coalesce(f("objeto", "objetoContrato"), F.lit("Subject not informed")), amount=f("valorInicial", "valorGlobal", "valorInicialCompra", "valor"),
        signed=F.coalesce(contract_date(f("dataAssinatura")), contract_date(f("dataPublicacao"))), buyer=buyer, supplier=supplier_of(df, supplier or "fornecedor", FLAT_SUPPLIER),
        modality=F.coalesce(f("modalidade", "modalidadeNome"), F.lit("not informed")), status=F.coalesce(f("situacao", "situacaoContrato"), F.lit("completed")))


def companies(df: DataFrame) -> DataFrame:
    """Rows of the registry's company files; a row without eight digits is left out."""
    return df.where(F.col("cnpj_basico").rlike(r"^\d{8}$")).select("cnpj_basico", "razao_social", "natureza_juridica", "qualificacao_responsavel", decimal_br(F.trim("capital_social"), MONEY).alias("capital_social"), "porte_empresa", "ente_federativo")


def establishments(df: DataFrame) -> DataFrame:
    """Rows of the establishment files with their whole number; rows whose number is not one of 14 digits are left out."""
    number = F.concat(*[F.coalesce(x, F.lit("")) for x in ("cnpj_basico", "cnpj_ordem", "cnpj_dv")])
    return df.withColumn("cnpj", number).where(F.col("cnpj").rlike(r"^\d{14}$") & F.col("cnpj_basico").rlike(r"^\d{8}$")).select(
        "cnpj", "cnpj_basico", F.coalesce(F.col("identificador_matriz_filial") == "1", F.lit(False)).alias("is_matriz"), "nome_fantasia", "situacao_cadastral", date_of(F.trim("data_situacao_cadastral")).alias("data_situacao_cadastral"),
        date_of(F.trim("data_inicio_atividade")).alias("data_inicio_atividade"), F.col("cnae_fiscal_principal").alias("cnae_principal"), "uf", "municipio", "cep", F.col("correio_eletronico").alias("email"))


def partner_key(company: Column, name: Column, role: Column) -> Column:
    """Half a hash of company, name and role: the document is masked and no key."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(x, F.lit("")) for x in (company, name, role)]), 256), 1, 32)


def partners(df: DataFrame) -> DataFrame:
    return df.where(F.col("cnpj_basico").rlike(r"^\d{8}$")).select(
        partner_key(F.col("cnpj_basico"), F.col("nome_socio_razao_social"), F.col("qualificacao_socio")).alias("partner_id"), "cnpj_basico", F.col("identificador_socio").alias("identificador"), F.col("nome_socio_razao_social").alias("nome"), F.col("qualificacao_socio").alias("qualificacao"),
        date_of(F.trim("data_entrada_sociedade")).alias("data_entrada"), "faixa_etaria", "cnpj_cpf_socio", "pais", "representante_legal", "nome_representante", "qualificacao_representante_legal")


def registry_municipalities(df: DataFrame) -> DataFrame:
    return df.where(F.col("tom_code").rlike(r"^\d{4}$")).select("tom_code", F.col("nome").alias("name"))


def election_document(x: Column) -> Column:
    d = digits(x)
    return F.when(F.length(d).isin(11, 14), d)


def _id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def campaign_donations(df: DataFrame) -> DataFrame:
    """Rows of the candidates' receipts; the registry's names come before those of the campaign. A row without both sequence numbers has
    the hash of its fields for an id."""
    f = lambda *p: F.coalesce(*[F.nullif(F.col(x), F.lit("")) if x in df.columns else F.lit(None).cast("string") for x in p])
    out = {
        "donor_document": election_document(f("NR_CPF_CNPJ_DOADOR")), "donor_name": f("NM_DOADOR_RFB", "NM_DOADOR"), "donor_origin_document": election_document(f("NR_CPF_CNPJ_DOADOR_ORIGINARIO")), "donor_origin_name": f("NM_DOADOR_ORIGINARIO_RFB", "NM_DOADOR_ORIGINARIO"),
        "donation_date": date_of(F.trim(f("DT_RECEITA"))), "amount": decimal_br(F.trim(f("VR_RECEITA")), MONEY), "revenue_origin": f("DS_ORIGEM_RECEITA"), "candidate_sequential": f("SQ_CANDIDATO"), "candidate_name": f("NM_CANDIDATO"), "party": f("SG_PARTIDO"), "office": f("DS_CARGO"), "ue_name": f("NM_UE"), "uf": f("SG_UF")}
    numbered = f("SQ_PRESTADOR_CONTAS").isNotNull() | f("SQ_RECEITA").isNotNull()
    identity = F.when(numbered, _id(f("SQ_PRESTADOR_CONTAS"), f("SQ_RECEITA"))).otherwise(F.substring(F.sha2(F.to_json(F.struct(*[x.alias(n) for n, x in sorted(out.items())], "election_year")), 256), 1, 32))
    return df.select(identity.alias("id"), "election_year", *[x.alias(n) for n, x in out.items()])


def candidacies(df: DataFrame) -> DataFrame:
    """Rows of the candidates' files, in the older or the newer layout, the newer one's fields first."""
    f = lambda *p: F.coalesce(*[F.col(x) if x in df.columns else F.lit(None).cast("string") for x in p])
    return df.select(_id(F.col("election_year"), f("SQ_CANDIDATO")).alias("id"), "election_year", f("SQ_CANDIDATO").alias("candidate_sequential"), f("NM_CANDIDATO").alias("candidate_name"), f("SG_PARTIDO").alias("party"), f("DS_CARGO").alias("office"),
                     f("SG_UE", "CD_UE").alias("ue_code"), f("NM_UE").alias("ue_name"), f("SG_UF").alias("uf"), f("DS_SIT_TOT_TURNO", "DS_SITUACAO_TOTALIZACAO_TURNO").alias("totalization_status"))


def sanction_date(x: Column) -> Column:
    """DD/MM/YYYY or YYYY-MM-DD and nothing else."""
    t = F.trim(x)
    return F.when(t.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})$"), date_of(t))


def masked_document(x: Column) -> Column:
    m = F.regexp_replace(x, r"[^0-9*]", "")
    return F.when(m.rlike(r"\d"), m)


def known(x: Column) -> Column:
    """Not the source's word for no information."""
    t = F.trim(x)
    return F.when((t != "") & (F.lower(t) != NO_INFORMATION), t)


def legal_basis(df: DataFrame) -> Column:
    if "fundamentacao" not in df.columns:
        return F.lit(None).cast("string")
    texts = F.filter(F.transform("fundamentacao", lambda x: x["descricao"]), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.nullif(F.array_join(texts, "; "), F.lit(""))


def sanctions(df: DataFrame, list_name: str) -> DataFrame:
    """Records of the lists of barred (ceis) and punished companies (cnep)."""
    f = lambda *p: field(df, *p)
    d, name = digits(f("sancionado.codigoFormatado", "pessoa.cnpjFormatado", "pessoa.cpfFormatado")), f("sancionado.nome", "pessoa.razaoSocialReceita", "pessoa.nome")
    cnpj, cpf = F.when(F.length(d) == 14, d), F.when(F.length(d) == 11, d)
    own = F.col("id").cast("string") if "id" in df.columns else F.lit(None).cast("string")
    return df.select(
        F.concat(F.lit(f"{list_name}-"), F.coalesce(own, cnpj, cpf, name, F.lit("unknown"))).alias("id"), F.lit(list_name).alias("list_name"), cnpj.alias("cnpj"), cpf.alias("cpf"), F.lit(None).cast("string").alias("masked_document"), name.alias("sanctioned_name"), f("orgaoSancionador.siglaUf").alias("uf"), f("orgaoSancionador.nome").alias("sanctioning_body"),
        f("tipoSancao.descricaoPortal", "tipoSancao.descricaoResumida").alias("sanction_type"), legal_basis(df).alias("legal_basis"), f("numeroProcesso").alias("process_number"), sanction_date(f("dataInicioSancao")).alias("start_date"), sanction_date(f("dataFimSancao")).alias("end_date"),
        sanction_date(f("dataPublicacaoSancao")).alias("publication_date"), decimal_br(F.trim(f("valorMulta")), MONEY).alias("fine_amount"))


def expulsions(df: DataFrame) -> DataFrame:
    """Records of the list of expelled officials (ceaf): the document is masked, and a sanction is in force from its publication, for ever."""
    f = lambda *p: field(df, *p)
    name, published = f("punicao.nomePunido", "pessoa.nome"), sanction_date(f("dataPublicacao"))
    own = F.col("id").cast("string") if "id" in df.columns else F.lit(None).cast("string")
    none = lambda kind="string": F.lit(None).cast(kind)
    return df.select(
        F.concat(F.lit("ceaf-"), F.coalesce(own, name, F.lit("unknown"))).alias("id"), F.lit("ceaf").alias("list_name"), none().alias("cnpj"), none().alias("cpf"), masked_document(f("punicao.cpfPunidoFormatado", "pessoa.cpfFormatado")).alias("masked_document"), name.alias("sanctioned_name"), known(f("ufLotacaoPessoa.uf.sigla")).alias("uf"),
        known(f("orgaoLotacao.nome")).alias("sanctioning_body"), f("tipoPunicao.descricao").alias("sanction_type"), legal_basis(df).alias("legal_basis"), f("punicao.processo").alias("process_number"), published.alias("start_date"), none("date").alias("end_date"), published.alias("publication_date"), none(MONEY).alias("fine_amount"))


def municipalities(df: DataFrame) -> DataFrame:
    """Rows of the reference of municipalities, with the state of the code's first two digits and the name as it is compared."""
    return df.select(digits(F.col("codigo_ibge")).alias("ibge_code"), F.nullif(F.trim("nome"), F.lit("")).alias("name"), code(UFS, F.trim(F.col("codigo_uf").cast("string"))).alias("uf"), F.nullif(digits(F.col("siafi_id")), F.lit("")).alias("siafi_code"),
                     F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"), plain_text(F.col("nome")).alias("compared_name"))


def with_municipality(df: DataFrame, reference: DataFrame, city: str, uf: str) -> DataFrame:
    """df with ibge_code, latitude and longitude of the municipality of its city and state, NULL where there is none; of equal names the
    smallest code."""
    first = reference.where("compared_name <> '' and uf is not null").groupBy(F.col("compared_name").alias("_name"), F.col("uf").alias("_uf")).agg(F.min(F.struct("ibge_code", "latitude", "longitude")).alias("_m"))
    joined = df.join(first, (plain_text(F.col(city)) == F.col("_name")) & (F.upper(F.trim(uf)) == F.col("_uf")), "left")
    return joined.select(*df.columns, F.col("_m.ibge_code").alias("ibge_code"), F.col("_m.latitude").alias("latitude"), F.col("_m.longitude").alias("longitude"))
