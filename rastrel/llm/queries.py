"""The registered queries of the corpus operators, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokenizers
from .decontaminate import contamination
from .lexical_search import lexical_search
from .licenses import license_scan
from .line_runs import dedup_lines
from .mixing import mix_sources
from .ngram_join import ngram_jaccard_components
from .quality import MOST_COVERED, MOST_LINES, quality_metrics
from .secrets import secret_spans, span_text
from .substrings import dedup_substrings
from .toxicity import toxicity_scores
from .url_filter import GLOBS, RULES, url_verdicts
from .wavelet import read_tokens, tokenizer_file, write_tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies: five words, similarity 0.75 or more.  Odd rows as in ``ngram_jaccard_components``."""
    return ngram_jaccard_components(_table(spark, sf_dir, "documents"))


def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, read back from wavelet matrix files.  Odd rows as in ``write_tokens``."""
    return read_tokens(*write_tokens(_table(spark, sf_dir, "documents"), tokenizer_file(), end_id=1)).drop("shard")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page.  Odd rows as in ``url_verdicts``."""
    return url_verdicts(_table(spark, sf_dir, "pages"))


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated line runs.  Odd rows as in ``dedup_lines``."""
    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "n_runs", "longest_run", F.sha2("text", 256).alias("text_sha256"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document.  Odd rows as in ``secret_spans``."""
    found = secret_spans(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of every document at 0.9 of the largest entropy, four at most.  Odd rows as in ``mix_sources``."""
    return mix_sources(_table(spark, sf_dir, "documents"), target_entropy=0.9, most_repeats=4.0)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document.  Odd rows as in ``contamination``."""
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document.  Odd rows as in ``toxicity_scores``."""
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in every document.  Odd rows as in ``license_scan``."""
    return license_scan(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition counts and verdict of every document.  Odd rows as in ``quality_metrics``."""
    return quality_metrics(_table(spark, sf_dir, "documents"))


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that start twice.  Odd rows as in ``dedup_substrings``."""
    cut = dedup_substrings(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens of two tokenizers in every document.  Odd rows as in ``align_tokenizers``."""
    found = align_tokenizers(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that score highest for every benchmark item.  Odd rows as in ``lexical_search``."""
    return lexical_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_wavelet_tokens, op3_url_filter, op4_line_runs, op5_secret_scan, op6_temperature_mixing, op7_benchmark_decontamination, op8_toxicity, op9_license_scan, op10_quality_rules, op11_suffix_array_dedup, op12_tokenizer_alignment, op13_lexical_search)}

SPACED, WORDS = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL_JOIN = f"""with recursive w as (select doc_id, regexp_extract_all(coalesce({FOLD}, ''), '{SPACED}') as ws from documents),
s as (select distinct doc_id, md5(array_to_string(list_slice(ws, i, i + 4), ' ')) as g from w, range(1, 20000000) t(i) where i <= greatest(len(ws) - 4, 0)
union select doc_id, md5('short ' || array_to_string(ws, ' ')) from w where len(ws) between 1 and 4),
n as (select doc_id, count(*) as n from s group by 1), p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)),
reach as (select doc_id as root, doc_id as near from documents union select r.root, l.b from reach r join links l on l.a = r.near)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id from documents d left join n on n.doc_id = d.doc_id join (select root, min(near) as component_id from reach group by 1) c on c.root = d.doc_id""".replace("w, range(1, 20000000) t(i) where i <= greatest(len(ws) - 4, 0)", "(select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 0) + 1)) as i from w)")


def _glob_sql(host: str, path: str) -> str:
    def regex(glob: str) -> str:
        return "(?s)" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if c in ".+()[]{}^$|\\" else c) for c in glob)

    return f"(regexp_full_match(host, '{regex(host)}') and regexp_full_match(path, '{regex(path)}'))"


SQL_URLS = f"""with a as (select page_id, coalesce(url, '') as u from pages), b as (select page_id, case when contains(u, '://') then substr(u, strpos(u, '://') + 3) else '' end as rest from a),
c as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from b), d as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw) + 1), '(?s)^[^?#]*') as path from c),
r(verdict, h, p) as (values {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
f as (select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as verdict from d join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by 1)
select d.page_id, host, path, rule, coalesce(f.verdict, case when {" or ".join(_glob_sql(h, p) for _, h, p in GLOBS)} then 'block' else 'allow' end) as verdict from d left join f on f.page_id = d.page_id"""

SQL_BENCHMARK = f"""with b as (select cast(item_id as varchar) as item, regexp_extract_all(coalesce({FOLD}, ''), '{WORDS}') as ws from benchmark), l as (select item, ws, least(10, len(ws)) as k from b where len(ws) > 0),
win as (select distinct item, k, list_slice(ws, i, i + k - 1) as g from (select *, unnest(range(1, len(ws) - k + 2)) as i from l)),
w as (select doc_id, regexp_extract_all(coalesce({FOLD}, ''), '{WORDS}') as ws from documents),
wd as (select doc_id, k, i, list_slice(ws, i, i + k - 1) as g from (select doc_id, ws, k, unnest(range(1, greatest(len(ws) - k + 1, 0) + 1)) as i from w, (select distinct k from win))),
hit as (select doc_id, wd.k, i, item from wd join win on win.k = wd.k and win.g = wd.g),
n as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + k)) as p from hit) group by 1),
it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hit) group by 1)
select w.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from w left join n on n.doc_id = w.doc_id left join it on it.doc_id = w.doc_id"""


def _covered_sql(n: int) -> str:
    return f"""g{n} as (select doc_id, i, list_slice(ws, i, i + {n - 1}) as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - {n - 1}, 0) + 1)) as i from w)),
c{n} as (select distinct doc_id, unnest(range(i, i + {n})) as p from (select doc_id, i, count(*) over (partition by doc_id, g) as k from g{n}) where k > 1),
s{n} as (select c.doc_id, count(*) as words, cast(sum(length(ws[p])) as bigint) as chars from c{n} c join w on w.doc_id = c.doc_id group by 1)"""


SQL_QUALITY = f"""with w as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{SPACED}') as ws from documents),
{", ".join(_covered_sql(n) for n in MOST_COVERED)},
l as (select doc_id, line, row_number() over (partition by doc_id, line) as k from (select doc_id, unnest(string_split(text, chr(10))) as line from w) where regexp_matches(line, '{SPACED}')),
dl as (select doc_id, count(*) as n, cast(sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) as bigint) as chars from l where k > 1 group by 1),
m as (select w.doc_id, len(ws) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars, cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, coalesce(dl.n, 0) as n_dup_lines, coalesce(s5.words, 0) as n_repeat_words, coalesce(dl.chars, 0) as dup_line_chars, {", ".join(f"coalesce(s{n}.chars, 0) as dup_chars_{n}" for n in MOST_COVERED)}
from w left join dl on dl.doc_id = w.doc_id {" ".join(f"left join s{n} on s{n}.doc_id = w.doc_id" for n in MOST_COVERED)}), b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select *, not base_failed and not (dup_line_chars * 100 > word_chars * {MOST_LINES} or {" or ".join(f"dup_chars_{n} * 100 > word_chars * {most}" for n, most in MOST_COVERED.items())}) as kept from b"""

ORACLES: dict[str, str] = {"op1_ngram_jaccard_join": SQL_JOIN, "op3_url_filter": SQL_URLS, "op7_benchmark_decontamination": SQL_BENCHMARK, "op10_quality_rules": SQL_QUALITY}
