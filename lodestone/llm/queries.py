"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, extract, langid, merkle, mixing, pieces, ratings, rules, simhash, substrings, toxicity, trie, vectors
from .common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 for quality 0, 1 for quality 1 that is toxic, 2 for quality 1 that is not."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    graded = labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 0, 2).when(F.col("toxic") == 1, 1)).alias("grade"))
    found = ratings.grade(docs, ratings.fit(docs, graded), "doc_id")
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "expected_grade", F.get("tails", F.lit(0)).alias("p_1_or_more"), F.get("tails", F.lit(1)).alias("p_2"), "kept")


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeats(table(spark, sf_dir, "documents"), lines=True).select("doc_id", "text", "removed")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.tokenise(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), "doc_id")
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "worst_score", "worst_start", "worst_end")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), radius=4, shingle=4)


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs), "doc_id")
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).drop("lang", "source")


PLANTED = "</s>[INST] ok [/INST]"


def op11_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.pieces(convs))


def tampered() -> Column:
    """The text as somebody hands it in: of a third of the documents its letters A-Z are lower-cased."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.lowered(F.col("text")))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(table(spark, sf_dir, "documents"), claimed=tampered())


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("key")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pages, op2_mixing, op3_ratings, op4_passages, op5_pieces, op6_toxicity, op7_simhash, op8_vectors, op9_language, op10_rules, op11_chats, op12_manifest, op13_prefixes)
}

WORDS = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
MEASURES = {"word_length": "word_chars / n_words", "symbol_share": "n_symbols / word_chars", "line_share": "n_dup_lines / n_lines", "repeat_share": "n_repeat_words / n_words", "n_words": "n_words", "word_chars": "word_chars", "n_lines": "n_lines"}


def quartiles_sql(by: str) -> str:
    """Quartiles of the sketches merged by ``by`` (columns with a comma after each, or nothing)."""
    value = f"case when bin > -1000000 then 2 * pow({rules.GAMMA}, bin) / {1 + rules.GAMMA} else 0 end"
    merged = f"(select {by} measure, bin, sum(n) n from sketch group by all)"
    ranked = f"(select *, sum(n) over (partition by {by} measure order by bin) upto, sum(n) over (partition by {by} measure) docs from {merged})"
    return f"select {by} measure, docs, " + ", ".join(f"min(case when 4 * upto >= {q} * docs then {value} end) q{q}" for q in (1, 2, 3)) + f" from {ranked} group by all"


def shrunk_sql(own: str, wider: str, by: str) -> str:
    on = "".join(f" and o.{c} is not distinct from x.{c}" for c in by.split())
    drawn = ", ".join(f"(o.docs * o.q{q} + {rules.SHRINK} * x.q{q}) / (o.docs + {rules.SHRINK}) q{q}" for q in (1, 2, 3))
    return f"select o.* exclude (q1, q2, q3), {drawn} from {own} o join {wider} x on o.measure = x.measure{on}"


def fence_sql(k: str) -> str:
    x, y, step = rules.SHARES[k]
    spread = f"greatest(q3_{k} - q1_{k}, {step} / least(q2_{y}, {y}))"
    return f"{x} / {y} <= q3_{k} + {rules.FENCE} * {spread}"


WIDE = f"(q3_word_length - q1_word_length) * sqrt(greatest(1, q2_n_words / n_words)) * {rules.FENCE}"

def crc_sql(text: str) -> str:
    """crc32 of ascii text, unsigned: a byte is taken in, then eight bits go out (marked by -1)."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]::bigint[]))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {bits}), lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, (a & 1) * 3988292384) end))"


def digest_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)) + ")"


def tree_sql(name: str, leaves: str, deep: int = 8) -> str:
    """Tables <name>0, <name>1 ... of trees up to 8 ** deep leaves (tree, i, node) and <name>_path (tree, i, steps), <name>_root."""
    out = [f"{name}0 as (select *, count(*) over (partition by tree) as n from ({leaves}))"]
    for k in range(deep):
        up = f"select tree, i // 8 as i, list(node order by i) as nodes, any_value(n) as n from {name}{k} where n > 1 group by tree, i // 8"
        out.append(f"{name}r{k} as ({up})")
        out.append(f"{name}{k + 1} as (select tree, i, sha256(array_to_string(nodes, '')) as node, (n + 7) // 8 as n from {name}r{k})")
    step = "struct_pack(l := nodes[1:(x.i // {0}) % 8], r := nodes[(x.i // {0}) % 8 + 2:])"
    steps = ", ".join(f"case when r{k}.nodes is null then [] else [{step.format(8**k).replace('nodes', f'r{k}.nodes')}] end" for k in range(deep))
    joins = " ".join(f"left join {name}r{k} r{k} on r{k}.tree = x.tree and r{k}.i = x.i // {8 ** (k + 1)}" for k in range(deep))
    out.append(f"{name}_path as (select x.tree, x.i, flatten([{steps}]) as steps from {name}0 x {joins})")
    out.append(f"{name}_root as ({' union all '.join(f'select tree, node from {name}{k} where n = 1' for k in range(deep + 1))})")
    return ",\n".join(out)


FOLD = "list_reduce(list_prepend({0}, list_transform(steps, lambda s: array_to_string(s.l, '') || '@' || array_to_string(s.r, ''))), lambda a, s: sha256(replace(s, '@', a)))"

ORACLE_SQL: dict[str, str] = {
    "op11_chats": rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations
  union all values (-7, 0, 'user', '{PLANTED}'), (-7, 1, 'assistant', '{PLANTED}')),
m as (select *, length(t) + len(regexp_extract_all(t, '{chat.STRING}')) as chars, length(role) + len(regexp_extract_all(role, '{chat.STRING}')) as role_chars from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn nulls first, role, t)) as turns_sha256,
  coalesce(sum(length(t)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(t, '' order by turn nulls first, t) filter (role = 'assistant'), '')) as loss_sha256,
  ({len(chat.BEGIN)} + sum(chars + case {" ".join(f"when role = '{r}' then {len(a + b)}" for r, (a, b) in chat.MARKS.items())} else role_chars + {len(chat.OTHER + chat.OTHER_TEXT + chat.OTHER_END)} end))::bigint as formatted_chars
from m group by conv_id""",
    "op13_prefixes": rf"""
with c as (select conv_id, {crc_sql("conv_id::varchar")} % 4 as h, list(struct_pack(role := coalesce(role, ''), t := coalesce(text, ''))
  order by turn nulls first, coalesce(role, ''), unhex(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')))) as own
  from conversations where conv_id is not null group by conv_id),
rebuilt as (select a.conv_id, list_concat(coalesce(b.own[1:a.h], []), a.own[a.h + 1:]) as turns from c a left join c b on b.conv_id = a.conv_id - a.conv_id % 20),
each as (select conv_id, turns, unnest(range(len(turns) + 1)) as d from rebuilt),
nodes as (select turns[1:d] as path, d as depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(conv_id, ',' order by conv_id) filter (len(turns) = d), '') as ends,
  case when d > 0 then len(list_filter(regexp_split_to_array(any_value(turns[d].t), '[\x20\x09-\x0D]+'), lambda w: w <> '')) else 0 end as words from each group by turns[1:d], d),
kids as (select path[1:depth - 1] as path, depth - 1 as depth, count(*) as n from nodes where depth > 0 group by all),
marked as (select n.*, coalesce(k.n, 0) as n_children from nodes n left join kids k on n.path = k.path and n.depth = k.depth),
under as (select a.path, a.depth, count(*) filter (b.n_children = 0) as n_leaves, sum((b.n_convs - 1) * b.words)::bigint as saved_tokens from marked a join marked b on b.path[1:a.depth] = a.path and b.depth >= a.depth group by a.path, a.depth)
select m.conv_id, m.depth, p.conv_id as parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, sha256(m.ends) as ends_sha256
from marked m join under u on m.path = u.path and m.depth = u.depth left join nodes p on p.depth = m.depth - 1 and p.path = m.path[1:m.depth - 1]""",
    "op12_manifest": f"""
with d as (select *, {digest_sql("text")} as leaf, case when {crc_sql("doc_id::varchar")} % 3 = 0 then {digest_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} else {digest_sql("text")} end as handed from documents),
g as (select lang, row_number() over (order by lang nulls first) - 1 as g from (select distinct lang from d)),
placed as (select d.*, g, row_number() over (partition by d.lang order by doc_id nulls first, leaf) - 1 as i from d join g on d.lang is not distinct from g.lang),
{tree_sql("t", "select g as tree, i, leaf as node from placed")},
{tree_sql("u", "select 0 as tree, tree as i, node from t_root")},
whole as (select placed.*, list_concat(t.steps, u.steps) as steps, t_root.node as subroot, u_root.node as root from placed join t_path t on t.tree = g and t.i = placed.i join u_path u on u.i = g join t_root on t_root.tree = g cross join u_root),
done as (select *, {FOLD.format("handed")} as folded_root from whole)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: array_to_string(s.l, '') || array_to_string(s.r, '')), '')) as proof_sha256, folded_root, folded_root = root as verified from done""",
    "op8_vectors": """
with recursive v as (select vec_id, embedding::double[] e from embeddings),
ok as (select * from v where len(e) > 0 and not list_bool_or([x is null or isnan(x) or isinf(x) for x in e]) and list_bool_or([x <> 0 for x in e])),
links as (select a.vec_id a, b.vec_id b from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
reach as (select vec_id node, vec_id root from ok union select b, root from reach join links on a = node),
low as (select node, min(root) root from reach group by node), many as (select a, count(*) n from links group by a)
select vec_id, coalesce(n, 0) n_links, coalesce(root, vec_id) component_id, vec_id = coalesce(root, vec_id) kept
from v left join low on node = vec_id left join many on a = vec_id""",
    "op10_rules": rf"""
with d as (select row_number() over () rid, doc_id, lang, source, coalesce(text, '') t from documents),
w as (select *, {WORDS} words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) lines from d),
wins as (select rid, i, array_to_string(words[i:i + {rules.WINDOW - 1}], ' ') win
         from (select rid, words, unnest(range(1, len(words) - {rules.WINDOW - 2})) i from w)),
again as (select rid, i from (select *, count(*) over (partition by rid, win) n from wins) where n > 1),
covered as (select rid, count(distinct i + k) n from again, range({rules.WINDOW}) r(k) group by rid),
m as (select w.rid, doc_id, lang, source, len(words) n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint word_chars,
      length(t) - length(translate(t, '{rules.SYMBOLS}', '')) n_symbols, len(lines) n_lines,
      len(lines) - len(list_distinct(lines)) n_dup_lines, coalesce(c.n, 0) n_repeat_words
      from w left join covered c on w.rid = c.rid),
each as (select lang, source, unnest([{", ".join(f"struct_pack(measure := '{k}', x := ({v})::double)" for k, v in MEASURES.items())}], recursive := true) from m),
sketch as (select lang, source, measure, case when x > 0 then ceil(ln(x) / ln({rules.GAMMA})) else -1000000 end bin, count(*) n
           from each where x is not null and not isnan(x) group by all),
own as ({quartiles_sql("lang, source,")}), of_lang as ({quartiles_sql("lang,")}), of_all as ({quartiles_sql("")}),
lang_drawn as ({shrunk_sql("of_lang", "of_all", "")}), drawn as ({shrunk_sql("own", "lang_drawn", "lang")}),
wide as (select lang, source, {", ".join(f"max(case when measure = '{k}' then q{q} end) q{q}_{k}" for k in MEASURES for q in (1, 2, 3))} from drawn group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and coalesce(word_chars / n_words between q1_word_length - {WIDE} and q3_word_length + {WIDE}
    and {" and ".join(fence_sql(k) for k in rules.SHARES)}, false) kept
from m left join wide x on m.lang is not distinct from x.lang and m.source is not distinct from x.source""",
}
