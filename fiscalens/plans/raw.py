"""Raw records made of the driver's tables, the queries that normalise them, and SQL that computes the same rows from the tables directly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import new_folder
from ..operators import normalizers as N
from ..sources import files
from ..sources.pages import page_stream, parsed, record_pages
from . import lens as L

line = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
text = lambda x: x.cast("string")


def pncp(s, d):
    """Records of the national portal: some without a control number, some with a code in place of a name, some with flat suppliers."""
    t = L.table(s, d, "lineitem").join(L.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    has, part = F.col("l_linenumber") != 2, F.col("l_partkey")
    struct = F.when(part % 4 != 0, F.struct(F.when(k_of(), F.format_string("%08d/0001-%02d", F.col("l_suppkey"), F.col("l_suppkey") % 100)).alias("cnpjFormatado"), F.concat(F.lit("Supplier "), text(F.col("l_suppkey"))).alias("razaoSocial"), F.lit("PE").alias("uf")))
    return t.select(
        F.when(has, F.concat_ws("-", *line)).otherwise("").alias("numeroControlePNCP"), text(F.col("l_orderkey")).alias("anoCompra"), text(part * 10 + F.col("l_linenumber")).alias("sequencial"),
        F.struct(F.format_string("%014d", F.col("o_custkey")).alias("cnpj"), F.element_at(F.array(F.lit("F"), F.lit("e "), F.lit("M"), F.lit("x")), (F.col("o_custkey") % 4 + 1).cast("int")).alias("esferaId")).alias("orgaoEntidade"),
        F.struct(F.when(F.col("o_custkey") % 5 != 0, text(F.col("o_custkey"))).alias("codigoUnidade"), F.lit("Unit").alias("nomeUnidade"), F.lit("pernambuco").alias("ufSigla"), F.lit("Recife").alias("municipioNome")).alias("unidadeOrgao"),
        struct.alias("fornecedor"), F.format_string("%011d", F.col("l_suppkey")).alias("niFornecedor"), F.lit("Flat name").alias("nomeRazaoSocialFornecedor"),
        F.when(F.col("l_linenumber") == 3, "0").otherwise(F.format_string("%d,5", F.col("l_quantity").cast("int"))).alias("valorTotalHomologado"), text(F.col("l_quantity").cast("int")).alias("valorGlobal"),
        F.when(part % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).alias("dataAssinatura"), F.date_format("l_shipdate", "yyyy-MM-dd'T'00:00:00").alias("dataPublicacaoPncp"),
        F.when(part % 7 == 0, "").otherwise("Pregão - Eletrônico").alias("modalidadeNome"), text(part % 16).alias("modalidadeId"), text(part % 6).alias("situacaoCompraId"))


def k_of():
    return F.col("l_suppkey") % 10 != 9


def transparency(s, d):
    o = L.table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.struct(F.when(F.col("o_custkey") % 3 != 0, text(F.col("o_custkey"))).alias("codigo"), F.lit("Organ").alias("nome"), F.struct(F.lit("26000").alias("codigo")).alias("orgaoVinculado")).alias("unidadeGestora"),
                    F.array(F.struct(F.format_string("%014d", F.col("o_custkey")).alias("cnpjFormatado"), F.lit("First").alias("nome"))).alias("fornecedores"), F.format_string("%d,25", F.col("o_custkey")).alias("valorInicial"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("dataAssinatura"), F.lit("Compra").alias("objeto"), F.when(F.col("o_orderstatus") == "F", "Concluído").alias("situacao"))


def company_files(s, d):
    k = F.col("s_suppkey")
    return L.table(s, d, "supplier").select(F.when(k % 13 == 0, "bad").otherwise(F.format_string("%08d", k)).alias("cnpj_basico"), F.col("s_name").alias("razao_social"), F.lit("2062").alias("natureza_juridica"), F.lit("49").alias("qualificacao_responsavel"), F.when(k % 5 != 0, F.format_string("%d.%03d,50", k, k % 1000)).otherwise("").alias("capital_social"), F.lit("01").alias("porte_empresa"), F.lit(None).cast("string").alias("ente_federativo"))


def establishment_files(s, d):
    k = F.col("s_suppkey")
    columns = {c: F.lit(None).cast("string") for c in files.ESTABLISHMENTS} | {
        "cnpj_basico": F.format_string("%08d", k), "cnpj_ordem": F.when(k % 11 == 0, "1").otherwise("0001"), "cnpj_dv": F.format_string("%02d", k % 100), "identificador_matriz_filial": F.when(k % 4 != 0, "1").otherwise("2"), "data_situacao_cadastral": F.when(k % 3 == 0, "00000000").otherwise(F.format_string("2020%02d15", k % 12 + 1)),
        "data_inicio_atividade": F.lit("19990131"), "cnae_fiscal_principal": F.lit("4120400"), "uf": F.lit("PE"), "municipio": F.format_string("%04d", F.col("s_nationkey")), "correio_eletronico": F.concat(text(k), F.lit("@x"))}
    return L.table(s, d, "supplier").select(*[v.alias(n) for n, v in columns.items()])


def partner_files(s, d):
    """Two partners a company: one whose role goes round the codes, and a company that owns it; some have a representative."""
    k = F.col("s_suppkey")
    t = L.table(s, d, "supplier")
    roles = F.array(*[F.lit(x) for x in ("05", "10", "22", "28", "49", "8", "65")])
    base = {c: F.lit(None).cast("string") for c in files.PARTNERS}
    person = base | {"cnpj_basico": F.format_string("%08d", k), "identificador_socio": F.lit("2"), "nome_socio_razao_social": F.concat(F.lit("Person "), text(k % 40)), "cnpj_cpf_socio": F.format_string("***%06d**", k), "qualificacao_socio": F.element_at(roles, (k % 7 + 1).cast("int")), "data_entrada_sociedade": F.format_string("2010%02d01", k % 12 + 1),
                     "nome_representante": F.when(k % 9 == 0, F.concat(F.lit("Agent "), text(k))), "qualificacao_representante_legal": F.when(k % 9 == 0, "17"), "faixa_etaria": text(k % 9)}
    owner = base | {"cnpj_basico": F.format_string("%08d", k), "identificador_socio": F.lit("1"), "nome_socio_razao_social": F.concat(F.lit("Holding "), text(k % 10)), "cnpj_cpf_socio": F.format_string("%08d000100", k % 10), "qualificacao_socio": F.lit("22"), "data_entrada_sociedade": F.lit("00000000")}
    rows = lambda of: t.select(*[v.alias(n) for n, v in of.items()])
    return rows(person).unionByName(rows(owner).where("cnpj_basico > '00000009'"))


def receipt_files(s, d):
    k = F.col("s_suppkey")
    return L.table(s, d, "supplier").select(
        F.lit(2024).alias("election_year"), F.when(k % 6 != 0, text(k)).alias("SQ_PRESTADOR_CONTAS"), F.when(k % 6 != 0, text(k + 7)).alias("SQ_RECEITA"), F.when(k % 2 == 0, "15/08/2024").otherwise("2024-08-15 10:00:00").alias("DT_RECEITA"), F.format_string("%d.%03d,00", k % 9, k % 1000).alias("VR_RECEITA"),
        F.format_string("%014d", k).alias("NR_CPF_CNPJ_DOADOR"), F.lit("Given name").alias("NM_DOADOR"), F.when(k % 3 == 0, "REGISTRY NAME").otherwise("").alias("NM_DOADOR_RFB"), F.when(k % 5 == 0, F.format_string("%011d", k)).otherwise("123").alias("NR_CPF_CNPJ_DOADOR_ORIGINARIO"), text(F.col("s_nationkey")).alias("SQ_CANDIDATO"), F.lit("PE").alias("SG_UF")).where("SQ_RECEITA is not null")


def candidate_files(s, d):
    n = F.col("n_nationkey")
    return L.table(s, d, "nation").select(F.lit(2024).alias("election_year"), text(n).alias("SQ_CANDIDATO"), F.col("n_name").alias("NM_CANDIDATO"), F.lit("Prefeito").alias("DS_CARGO"), F.lit("old").alias("CD_UE"), F.when(n % 2 == 0, text(n + 100)).alias("SG_UE"), F.when(n % 3 == 0, "ELEITO").alias("DS_SIT_TOT_TURNO"), F.lit("2º TURNO").alias("DS_SITUACAO_TOTALIZACAO_TURNO"))


def sanction_records(s, d):
    k = F.col("s_suppkey")
    t = L.table(s, d, "supplier")
    basis = F.array(F.struct(F.lit("Lei 1").alias("descricao")), F.struct(F.when(k % 2 == 0, "Lei 2").alias("descricao")))
    return t.select(F.when(k % 8 != 0, k).alias("id"), F.struct(F.when(k % 3 == 0, F.format_string("%03d.111.222-33", k % 1000)).otherwise(F.format_string("%014d", k)).alias("codigoFormatado"), F.col("s_name").alias("nome")).alias("sancionado"), F.struct(F.lit("PE").alias("siglaUf"), F.lit("Court").alias("nome")).alias("orgaoSancionador"),
                    F.struct(F.lit("").alias("descricaoPortal"), F.lit("Barred").alias("descricaoResumida")).alias("tipoSancao"), basis.alias("fundamentacao"), F.lit("31/01/2020").alias("dataInicioSancao"), F.when(k % 4 == 0, "2021-06-30").otherwise("Sem data").alias("dataFimSancao"), F.lit("1.234,56").alias("valorMulta"))


def expulsion_records(s, d):
    k = F.col("s_suppkey")
    return L.table(s, d, "supplier").select(k.alias("id"), F.struct(F.lit("").alias("nomePunido"), F.format_string("***.%03d.151-**", k % 1000).alias("cpfPunidoFormatado"), F.lit("P-1").alias("processo")).alias("punicao"), F.struct(F.col("s_name").alias("nome")).alias("pessoa"),
                                            F.struct(F.when(k % 2 == 0, "Sem Informação").otherwise("Ministry").alias("nome")).alias("orgaoLotacao"), F.struct(F.struct(F.lit("RJ").alias("sigla")).alias("uf")).alias("ufLotacaoPessoa"), F.lit("05/03/2019").alias("dataPublicacao"))


def places(s, d):
    n = F.col("n_nationkey")
    uf = F.element_at(F.array(*[F.lit(x) for x in sorted(N.UFS)]), (n + 1).cast("int"))
    return L.table(s, d, "nation").select(F.concat(uf, F.format_string("%05d", n)).alias("codigo_ibge"), F.concat(F.lit(" São "), F.col("n_name")).alias("nome"), uf.alias("codigo_uf"), F.format_string("%04d", n).alias("siafi_id"), (n * 1.25 - 20).alias("latitude"), (n * -0.75 - 40).alias("longitude"))


def located(s, d):
    """Towns of contracts as people type them, resolved against the reference."""
    asked = L.table(s, d, "nation").select("n_nationkey", F.concat(F.lit("sao  "), F.lower(F.translate("n_name", "_", "-"))).alias("city"), F.when(F.col("n_nationkey") % 5 != 0, F.element_at(F.array(*[F.lit(N.UFS[x].lower()) for x in sorted(N.UFS)]), (F.col("n_nationkey") + 1).cast("int"))).alias("state"))
    return N.with_municipality(asked, N.municipalities(places(s, d)), "city", "state").select("n_nationkey", "ibge_code", "latitude", "longitude")


def flat(df):
    return df.select("id", "process_number", "subject", F.col("amount").cast("double").alias("amount"), "signature_date", "validity_start", "validity_end", *[F.col(f"buyer.{x}").alias(f"buyer_{x}") for x in ("siafi_code", "name", "government_level", "uf", "city")], *[F.col(f"supplier.{x}").alias(f"supplier_{x}") for x in ("cnpj", "cpf", "legal_name", "state")], "modality", "status")


def recorded(df, window, per_page=500):
    """The folder of df's rows as a paged source would have answered."""
    path = new_folder(df.sparkSession, "pages")
    record_pages(df, path, window, per_page)
    return path


def pncp_months(s, d):
    """The portal's records by month of publication."""
    return recorded(pncp(s, d).withColumns({"modalidadeId": F.col("modalidadeId").cast("int"), "situacaoCompraId": F.col("situacaoCompraId").cast("int"), "_month": F.substring("dataPublicacaoPncp", 1, 7)}), "_month")


def transparency_agencies(s, d):
    return recorded(transparency(s, d).withColumn("_agency", F.coalesce("unidadeGestora.codigo", F.lit("none"))), "_agency", 100)


def streamed_pncp(s, d):
    """The same records by a stream that ends with the months there are up to one of them, and is taken up again for the rest."""
    path, folder = pncp_months(s, d), new_folder(s, "page-stream")
    for upto in ({"to": "1995-06"}, {}):
        parsed(page_stream(s, path, **upto), files.CONTRACT_RECORD).writeStream.format("parquet").option("compression", "zstd").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{folder}/out")


money = lambda df, *c: df.withColumns({x: F.col(x).cast("double") for x in c})
QUERIES = {
    "normalize_pncp": lambda s, d: flat(N.contracts_from_pncp(pncp(s, d), "2024-05-01")),
    "pncp_pages": lambda s, d: flat(N.contracts_from_pncp(files.read(s, "pncp_pages", pncp_months(s, d)), "2024-05-01")),
    "pncp_page_stream": lambda s, d: flat(N.contracts_from_pncp(streamed_pncp(s, d), "2024-05-01")),
    "transparency_pages": lambda s, d: flat(N.contracts_from_transparency(files.read(s, "transparency_pages", transparency_agencies(s, d)), "2024-05-01")),
    "sanction_pages": lambda s, d: money(N.sanctions(files.read(s, "ceis_pages", recorded(sanction_records(s, d).withColumn("_all", F.lit("all")), "_all", 15)), "ceis"), "fine_amount"),
    "normalize_transparency": lambda s, d: flat(N.contracts_from_transparency(transparency(s, d), "2024-05-01")),
    "normalize_companies": lambda s, d: money(N.companies(company_files(s, d)), "capital_social"),
    "normalize_establishments": lambda s, d: N.establishments(establishment_files(s, d)).select("cnpj", "cnpj_basico", "is_matriz", "data_situacao_cadastral", "data_inicio_atividade", "cnae_principal", "uf", "municipio", "email"),
    "normalize_partners": lambda s, d: N.partners(partner_files(s, d)).select("partner_id", "cnpj_basico", "identificador", "nome", "qualificacao", "data_entrada", "cnpj_cpf_socio", "nome_representante"),
    "normalize_donations": lambda s, d: money(N.campaign_donations(receipt_files(s, d)), "amount").select("id", "election_year", "donor_document", "donor_name", "donor_origin_document", "donation_date", "amount", "candidate_sequential", "uf"),
    "normalize_candidacies": lambda s, d: N.candidacies(candidate_files(s, d)),
    "normalize_sanctions": lambda s, d: money(N.sanctions(sanction_records(s, d), "ceis"), "fine_amount"),
    "normalize_expulsions": lambda s, d: money(N.expulsions(expulsion_records(s, d)), "fine_amount"),
    "normalize_municipalities": lambda s, d: N.municipalities(places(s, d)),
    "municipality_lookup": located,
}
LEVEL = "CASE o_custkey % 4 WHEN 0 THEN 'federal' WHEN 1 THEN 'state' WHEN 2 THEN 'municipal' ELSE 'federal' END"
MODE = "CASE l_partkey % 16 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in N.MODALITIES.items()) + " ELSE 'not_informed' END"
STATUS = "CASE l_partkey % 6 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in N.STATUSES.items()) + " ELSE 'published' END"
UF_CODES = "[" + ", ".join(f"'{x}'" for x in sorted(N.UFS)) + "]"
UF_NAMES = "[" + ", ".join(f"'{N.UFS[x]}'" for x in sorted(N.UFS)) + "]"
pad = lambda x, n: f"lpad(CAST({x} AS VARCHAR), {n}, '0')"
SQL = {
    "normalize_pncp": f"""SELECT CASE WHEN l_linenumber <> 2 THEN l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey ELSE concat_ws('-', {pad('o_custkey', 14)}, CAST(l_orderkey AS VARCHAR), CAST(l_partkey * 10 + l_linenumber AS VARCHAR)) END AS id, id AS process_number, 'Subject not informed' AS subject,
      CASE WHEN l_linenumber = 3 THEN 0.0::DOUBLE ELSE trunc(l_quantity) + 0.5 END AS amount, CASE WHEN l_partkey % 3 = 0 THEN CAST(o_orderdate AS DATE) ELSE CAST(l_shipdate AS DATE) END AS signature_date, signature_date AS validity_start, signature_date AS validity_end,
      CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_custkey AS VARCHAR) ELSE {pad('o_custkey', 14)} END AS buyer_siafi_code, 'Unit' AS buyer_name, {LEVEL} AS buyer_government_level, 'PE' AS buyer_uf, 'Recife' AS buyer_city,
      CASE WHEN l_partkey % 4 <> 0 AND l_suppkey % 10 <> 9 THEN {pad('l_suppkey', 8)} || '0001' || {pad('l_suppkey % 100', 2)} END AS supplier_cnpj, CASE WHEN l_partkey % 4 = 0 OR l_suppkey % 10 = 9 THEN {pad('l_suppkey', 11)} END AS supplier_cpf,
      CASE WHEN l_partkey % 4 <> 0 THEN 'Supplier ' || l_suppkey ELSE 'Flat name' END AS supplier_legal_name, CASE WHEN l_partkey % 4 <> 0 THEN 'PE' END AS supplier_state, CASE WHEN l_partkey % 7 <> 0 THEN 'pregão - eletrônico' ELSE {MODE} END AS modality, {STATUS} AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "normalize_transparency": f"""SELECT CASE WHEN o_orderkey = 0 THEN 'unknown' ELSE CAST(o_orderkey AS VARCHAR) END AS id, id AS process_number, 'Compra' AS subject, o_custkey + 0.25::DOUBLE AS amount, CAST(o_orderdate AS DATE) AS signature_date, signature_date AS validity_start, signature_date AS validity_end, CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_custkey AS VARCHAR) ELSE '26000' END AS buyer_siafi_code, 'Organ' AS buyer_name,
      'federal' AS buyer_government_level, '' AS buyer_uf, CAST(NULL AS VARCHAR) AS buyer_city, {pad('o_custkey', 14)} AS supplier_cnpj, CAST(NULL AS VARCHAR) AS supplier_cpf, 'First' AS supplier_legal_name, CAST(NULL AS VARCHAR) AS supplier_state, 'not informed' AS modality, CASE WHEN o_orderstatus = 'F' THEN 'concluído' ELSE 'completed' END AS status FROM orders""",
    "normalize_companies": f"SELECT {pad('s_suppkey', 8)} AS cnpj_basico, s_name AS razao_social, '2062' AS natureza_juridica, '49' AS qualificacao_responsavel, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey * 1000 + s_suppkey % 1000 + 0.5::DOUBLE END AS capital_social, '01' AS porte_empresa, CAST(NULL AS VARCHAR) AS ente_federativo FROM supplier WHERE s_suppkey % 13 <> 0",
    "normalize_establishments": f"SELECT {pad('s_suppkey', 8)} || '0001' || {pad('s_suppkey % 100', 2)} AS cnpj, {pad('s_suppkey', 8)} AS cnpj_basico, s_suppkey % 4 <> 0 AS is_matriz, CASE WHEN s_suppkey % 3 <> 0 THEN make_date(2020, CAST(s_suppkey % 12 + 1 AS INTEGER), 15) END AS data_situacao_cadastral, DATE '1999-01-31' AS data_inicio_atividade, '4120400' AS cnae_principal, 'PE' AS uf, {pad('s_nationkey', 4)} AS municipio, s_suppkey || '@x' AS email FROM supplier WHERE s_suppkey % 11 <> 0",
    "normalize_partners": f"""SELECT substr(sha256(cnpj_basico || '|' || nome || '|' || qualificacao), 1, 32) AS partner_id, * FROM (
      SELECT {pad('s_suppkey', 8)} AS cnpj_basico, '2' AS identificador, 'Person ' || (s_suppkey % 40) AS nome, ['05', '10', '22', '28', '49', '8', '65'][s_suppkey % 7 + 1] AS qualificacao, make_date(2010, CAST(s_suppkey % 12 + 1 AS INTEGER), 1) AS data_entrada, '***' || {pad('s_suppkey', 6)} || '**' AS cnpj_cpf_socio, CASE WHEN s_suppkey % 9 = 0 THEN 'Agent ' || s_suppkey END AS nome_representante FROM supplier
      UNION ALL SELECT {pad('s_suppkey', 8)}, '1', 'Holding ' || (s_suppkey % 10), '22', NULL, {pad('s_suppkey % 10', 8)} || '000100', NULL FROM supplier WHERE s_suppkey > 9)""",
    "normalize_donations": f"SELECT substr(sha256(s_suppkey || '|' || (s_suppkey + 7)), 1, 32) AS id, 2024 AS election_year, {pad('s_suppkey', 14)} AS donor_document, CASE WHEN s_suppkey % 3 = 0 THEN 'REGISTRY NAME' ELSE 'Given name' END AS donor_name, CASE WHEN s_suppkey % 5 = 0 THEN {pad('s_suppkey', 11)} END AS donor_origin_document, DATE '2024-08-15' AS donation_date, CAST(s_suppkey % 9 * 1000 + s_suppkey % 1000 AS DOUBLE) AS amount, CAST(s_nationkey AS VARCHAR) AS candidate_sequential, 'PE' AS uf FROM supplier WHERE s_suppkey % 6 <> 0",
    "normalize_candidacies": "SELECT substr(sha256('2024|' || n_nationkey), 1, 32) AS id, 2024 AS election_year, CAST(n_nationkey AS VARCHAR) AS candidate_sequential, n_name AS candidate_name, CAST(NULL AS VARCHAR) AS party, 'Prefeito' AS office, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey + 100 AS VARCHAR) ELSE 'old' END AS ue_code, CAST(NULL AS VARCHAR) AS ue_name, CAST(NULL AS VARCHAR) AS uf, CASE WHEN n_nationkey % 3 = 0 THEN 'ELEITO' ELSE '2º TURNO' END AS totalization_status FROM nation",
    "normalize_sanctions": f"SELECT 'ceis-' || CASE WHEN s_suppkey % 8 <> 0 THEN CAST(s_suppkey AS VARCHAR) ELSE CASE WHEN s_suppkey % 3 <> 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 14, '0') ELSE lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') || '11122233' END END AS id, 'ceis' AS list_name, CASE WHEN s_suppkey % 3 <> 0 THEN {pad('s_suppkey', 14)} END AS cnpj, CASE WHEN s_suppkey % 3 = 0 THEN {pad('s_suppkey % 1000', 3)} || '11122233' END AS cpf, CAST(NULL AS VARCHAR) AS masked_document, s_name AS sanctioned_name, 'PE' AS uf, 'Court' AS sanctioning_body, 'Barred' AS sanction_type, CASE WHEN s_suppkey % 2 = 0 THEN 'Lei 1; Lei 2' ELSE 'Lei 1' END AS legal_basis, CAST(NULL AS VARCHAR) AS process_number, DATE '2020-01-31' AS start_date, CASE WHEN s_suppkey % 4 = 0 THEN DATE '2021-06-30' END AS end_date, CAST(NULL AS DATE) AS publication_date, 1234.56::DOUBLE AS fine_amount FROM supplier",
    "normalize_expulsions": f"SELECT 'ceaf-' || s_suppkey AS id, 'ceaf' AS list_name, CAST(NULL AS VARCHAR) AS cnpj, CAST(NULL AS VARCHAR) AS cpf, '***' || {pad('s_suppkey % 1000', 3)} || '151**' AS masked_document, s_name AS sanctioned_name, 'RJ' AS uf, CASE WHEN s_suppkey % 2 <> 0 THEN 'Ministry' END AS sanctioning_body, CAST(NULL AS VARCHAR) AS sanction_type, CAST(NULL AS VARCHAR) AS legal_basis, 'P-1' AS process_number, DATE '2019-03-05' AS start_date, CAST(NULL AS DATE) AS end_date, DATE '2019-03-05' AS publication_date, CAST(NULL AS DOUBLE) AS fine_amount FROM supplier",
    "normalize_municipalities": f"SELECT {UF_CODES}[n_nationkey + 1] || {pad('n_nationkey', 5)} AS ibge_code, 'São ' || n_name AS name, {UF_NAMES}[n_nationkey + 1] AS uf, {pad('n_nationkey', 4)} AS siafi_code, CAST(n_nationkey * 1.25 - 20 AS DOUBLE) AS latitude, CAST(n_nationkey * -0.75 - 40 AS DOUBLE) AS longitude, 'SAO ' || replace(upper(n_name), '_', ' ') AS compared_name FROM nation",
    "municipality_lookup": f"SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 0 THEN {UF_CODES}[n_nationkey + 1] || {pad('n_nationkey', 5)} END AS ibge_code, CASE WHEN n_nationkey % 5 <> 0 THEN CAST(n_nationkey * 1.25 - 20 AS DOUBLE) END AS latitude, CASE WHEN n_nationkey % 5 <> 0 THEN CAST(n_nationkey * -0.75 - 40 AS DOUBLE) END AS longitude FROM nation",
}
SQL |= {"pncp_pages": SQL["normalize_pncp"], "pncp_page_stream": SQL["normalize_pncp"], "transparency_pages": SQL["normalize_transparency"], "sanction_pages": SQL["normalize_sanctions"]}
