"""Queries of the text problems.

SQL can't count tokens, so the queries over tokens have none. The same operators run over
bytes in queries whose results SQL can tell, and pieces are put together again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.llm.mixing import Mixture
from telar.llm.packing import occupancy, pack
from telar.llm.splitting import cuts, split
from telar.llm.tokens import sized
from telar.session import checkpoint, spread, table


def _limits(spark: SparkSession, d: str, use: str) -> list[tuple[int, int]]:
    """The limits of one use; a fixed table of parameters."""
    rows = table(spark, d, "limite_texto").filter((F.col("uso") == use) & (F.col("max_tokens") > 0)).collect()
    return sorted({(r.max_tokens, r.solape_tokens or 0) for r in rows})


def _documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The texts, spread where one file holds them all: tokens and cuts are dear."""
    return spread(table(spark, d, "documents").select("doc_id", "text", *columns), "doc_id")


def p6_contenedores(spark: SparkSession, d: str) -> DataFrame:
    sizes = checkpoint(sized(_documents(spark, d), "doc_id"))
    return pack(sizes, [c for c, _ in _limits(spark, d, "contenedor")])


def p6_ocupacion(spark: SparkSession, d: str) -> DataFrame:
    return occupancy(p6_contenedores(spark, d))


def _mixture(spark: SparkSession, d: str, whole: bool = False) -> Mixture:
    sizes = checkpoint(sized(_documents(spark, d, "source"), "doc_id", "source"))
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0 if whole else None
    return Mixture(sizes, table(spark, d, "mezcla_objetivo"), total=total)


def p7_mezcla(spark: SparkSession, d: str) -> DataFrame:
    """The largest mixture in which every source that has texts holds its share."""
    return _mixture(spark, d).chosen()


def p7_cuotas(spark: SparkSession, d: str) -> DataFrame:
    m = _mixture(spark, d)
    return m.reached(m.chosen())


def p7_mezcla_completa(spark: SparkSession, d: str) -> DataFrame:
    """As many tokens as the texts have: scarce sources fall short of their shares."""
    return _mixture(spark, d, whole=True).chosen()


def p7_cuotas_completa(spark: SparkSession, d: str) -> DataFrame:
    m = _mixture(spark, d, whole=True)
    return m.reached(m.chosen())


def p8_piezas(spark: SparkSession, d: str) -> DataFrame:
    return split(_documents(spark, d), _limits(spark, d, "pieza"))


def p8_cortes(spark: SparkSession, d: str) -> DataFrame:
    return cuts(p8_piezas(spark, d))


def _bytes(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return table(spark, d, "documents").select(*keep, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_tokens"))


def p6_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Containers measured in bytes: what each text's parts hold together, and whether no container holds more than it may."""
    packed = checkpoint(pack(_bytes(spark, d, "doc_id"), [c for c, _ in _limits(spark, d, "contenedor")]))
    bins = packed.groupBy("max_tokens", "id_contenedor").agg((F.sum("n_tokens") <= F.col("max_tokens")).alias("cabe")).groupBy("max_tokens").agg(F.every("cabe").alias("caben"))
    texts = packed.groupBy("max_tokens", "doc_id").agg(F.count("*").alias("partes"), F.sum("n_tokens").alias("octetos"), F.max("n_tokens").alias("mayor"))
    return texts.join(bins, "max_tokens").select("max_tokens", "doc_id", "partes", "octetos", "mayor", "caben")


_P6 = """with c as (select distinct max_tokens from limite_texto where uso = 'contenedor' and max_tokens > 0), t as (select doc_id, coalesce(octet_length(encode(text)), 0) n from documents)
select c.max_tokens, t.doc_id, greatest(1, cast(ceil(n / c.max_tokens::double) as bigint)) partes, cast(n as bigint) octetos, cast(least(n, c.max_tokens) as integer) mayor, true caben from t, c"""


def p7_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The mixture measured in bytes: shares asked for, what there is, and whether each source holds its share to within half its longest text and its repetitions."""
    sizes = _bytes(spark, d, "doc_id", "source")
    m = Mixture(sizes, table(spark, d, "mezcla_objetivo"))
    chosen = checkpoint(m.chosen())
    longest = sizes.groupBy("source").agg(F.max("n_tokens").alias("_mayor"))
    asked = spark.createDataFrame([(s.source, s.demand) for s in m.shares], "source string, demanda double")
    all_ = m.reached(chosen).join(asked, "source").join(longest, "source", "left")
    held = (F.abs(F.col("tokens") - F.col("demanda")) <= F.coalesce(F.col("_mayor"), F.lit(0)) / 2 + 1) & (F.col("repeticiones") <= F.col("max_repeticiones"))
    return all_.select("source", F.round("cuota_objetivo", 6).alias("cuota_objetivo"), F.round("cuota_presente", 6).alias("cuota_presente"), "max_repeticiones", F.col("tokens_disponibles").alias("octetos"), F.round("demanda", 2).alias("demanda"), held.alias("cumple"))


_P7 = """with o as (select source, max(cast(peso_objetivo as double)) w, max(coalesce(max_repeticiones, 1)) r from mezcla_objetivo where source is not null and peso_objetivo > 0 and coalesce(max_repeticiones, 1) > 0 group by 1),
h as (select source, sum(octet_length(encode(text))) n from documents where text <> '' group by 1), j as (select o.*, coalesce(h.n, 0) n from o left join h using (source)),
s as (select (select sum(w) from j) todo, (select sum(w) from j where n > 0) hay, (select min(r * n * (select sum(w) from j where n > 0) / w) from j where n > 0) total)
select source, round(w / todo, 6) cuota_objetivo, round(case when n > 0 then w / hay else 0.0 end, 6) cuota_presente, r max_repeticiones, cast(n as bigint) octetos, round(case when n > 0 then least(r * n, total * w / hay) else 0.0 end, 2) demanda, true cumple from j, s"""


def p8_recompuesto(spark: SparkSession, d: str) -> DataFrame:
    """Texts put together again from their pieces without overlap, for each limit: the hash of the whole; texts within a limit as they are."""
    limits = sorted({c for c, _ in _limits(spark, d, "pieza")})
    docs = _documents(spark, d).filter("text is not null")
    pieces = split(docs, [(c, 0) for c in limits]).groupBy("doc_id", "max_tokens").agg(F.sort_array(F.collect_list(F.struct("pieza", "texto"))).alias("x"))  # a text's own pieces
    whole = pieces.select("doc_id", "max_tokens", F.array_join("x.texto", "").alias("t"))
    every = docs.select("doc_id", "text", F.explode(F.array(*[F.lit(c) for c in limits])).alias("max_tokens"))
    return every.join(whole, ["doc_id", "max_tokens"], "left").select("doc_id", "max_tokens", F.sha2(F.coalesce("t", "text"), 256).alias("huella"))


_P8 = """select doc_id, max_tokens, sha256(text) huella from documents, (select distinct max_tokens from limite_texto where uso = 'pieza' and max_tokens > 0) where text is not null"""

QUERIES = {q.__name__: q for q in (p6_contenedores, p6_ocupacion, p6_bytes, p7_mezcla, p7_cuotas, p7_mezcla_completa, p7_cuotas_completa, p7_bytes, p8_piezas, p8_cortes, p8_recompuesto)}
SQL: dict[str, str] = {"p6_bytes": _P6, "p7_bytes": _P7, "p8_recompuesto": _P8}
