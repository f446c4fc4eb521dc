"""The registered queries of the operators on conversations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chats, repairs, tries

HARD = "\\### Assistant: </turn> ok"


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = _conversations(spark, sf_dir).select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    back = chats.read_chats(chats.format_chats(talks.unionByName(hard)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = back.withColumn("loss", F.array_join("loss_texts", ""))
    return loss.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(tries.grafted(tries.turn_sequences(_conversations(spark, sf_dir))))


def damaged(talks: DataFrame) -> DataFrame:
    """Rows dropped (there is false), emptied, without ends of sentences, repeated, or given to the user, by a CRC-32."""
    kind = tries.crc32_of(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    own = {c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")}
    rows = talks.select("conv_id", "turn", *(c.alias(n) for n, c in own.items()), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))),
    ).drop("col")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repairs.repair(damaged(_conversations(spark, sf_dir)), there=F.col("there"))
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return got.select(*(c for c in got.columns if c != "repaired"), F.sha2(lines, 256).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (op11_chat_format, op12_prefix_trie, op13_structure_repair)}


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    eight = "list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, z: xor(p >> 1, 3988292384::bigint * (p & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)), lambda a, c: {eight}), 4294967295::bigint)"


_ELEVEN = r"""
with talks as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, t, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) as v(t, r)),
sized as (select *, len(text) + len(regexp_extract_all(text, '\\')) + len(regexp_extract_all(text, '<turn>|</turn>\n|<part/>|<line/>')) as text_size,
    len(replace(role, chr(10), '<line/>')) + len(regexp_extract_all(role, '\\')) + len(regexp_extract_all(role, '<turn>|</turn>\n|<part/>|<line/>')) as role_size,
    role is not distinct from lag(role) over (partition by conv_id order by turn nulls first, role, text) as joined from talks)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    coalesce(sum(len(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    sum(text_size + case when joined then 7 else 6 + role_size + 1 + 8 end)::bigint as formatted_chars
from sized group by conv_id
"""

_TWELVE = rf"""
with own as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, role, text) as k, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
convs as (select c, {_crc32("c::varchar")} % 4 as h from (select distinct c from own)),
parts as (select v.c, 0 as part, o.k, o.role, o.text from convs v join own o on o.c = v.c - v.c % 20 and o.k <= v.h
    union all select v.c, 1, o.k, o.role, o.text from convs v join own o on o.c = v.c and o.k > v.h),
seq as (select c, row_number() over (partition by c order by part, k) as d, role, text from parts),
members as (select c, 0 as d, '' as key, 0 as words from convs
    union all select c, d, sha256(string_agg(len(role) || ':' || role || len(text) || ':' || text, '') over (partition by c order by d)), len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) from seq),
lens as (select c, max(d) as d from members group by c),
nodes as (select d, key, min(c) as conv_id, count(*) as n_convs, min(words) as words from members group by d, key),
ups as (select n.*, p.key as up from nodes n left join members p on p.c = n.conv_id and p.d = n.d - 1),
kids as (select d - 1 as d, up as key, count(*) as n from ups where d > 0 group by all),
ended as (select d, key, string_agg(c::varchar, ',' order by c) as ids from lens join members using (c, d) group by d, key),
below as (select a.d, a.key, sum((x.n_convs - 1) * x.words) as saved, count(*) filter (k.n is null) as leaves
    from nodes x left join kids k on k.d = x.d and k.key = x.key join members a on a.c = x.conv_id and a.d <= x.d group by a.d, a.key)
select u.conv_id, u.d::bigint as depth, p.conv_id as parent_conv_id, u.n_convs, coalesce(k.n, 0) as n_children, b.leaves as n_leaves, b.saved::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from ups u left join nodes p on p.d = u.d - 1 and p.key = u.up left join kids k on k.d = u.d and k.key = u.key join below b on b.d = u.d and b.key = u.key left join ended e on e.d = u.d and e.key = u.key
"""

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_STEPS = "(0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)"
_THIRTEEN = rf"""
with recursive raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind from conversations),
after as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, n
    from raw join (values (1), (2)) as v(n) on n = 1 or kind = 3 where kind <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, n) as i, rtrim(text, {_BLANK}) as t, left(role, 1) as initial from after),
faults as (select *, case when t = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when right(t, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    lag(initial) over (partition by conv_id order by i) || initial as pair from placed),
steps as (select * from (values {_STEPS}) as v(q, r, q2)),
one as (select q, q2 from steps where r <> 's'),
gaps as (select q, q as q2, '' as letters, 0 as cost from (values (0), (1), (2), (3)) as v(q) union all select q, q2, 'I', 3 from one union all select a.q, b.q2, 'II', 6 from one a join one b on b.q = a.q2),
acts as (select q, q as q2, null as r, 'D' as letter, 4 as cost from (values (0), (1), (2), (3)) as v(q) union all select q, q2, r, 'K', 0 from steps union all select q, q2, null, 'R', 3 from one),
moves as (select g.q, a.q2, a.r, g.letters || a.letter as letters, g.cost + a.cost as cost, a.letter from gaps g join acts a on a.q = g.q2),
best as (select conv_id, 0::bigint as i, 0 as q, '00000000' as key from (select distinct conv_id from conversations)
    union all
    select b.conv_id, f.i, m.q2, min(lpad((left(b.key, 8)::bigint + m.cost + case when f.fault = 'truncated' and m.letter <> 'D' then 3 else 0 end)::varchar, 8, '0') || b.key[9:] || m.letters)
    from best b join faults f on f.conv_id is not distinct from b.conv_id and f.i = b.i + 1 join moves m on m.q = b.q and (m.r is null or m.r = f.initial) and (m.letter = 'D' or f.fault not in ('blank', 'duplicate'))
    group by b.conv_id, f.i, m.q2),
counts as (select c.conv_id, count(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
    from (select distinct conv_id from conversations) c left join faults f on f.conv_id is not distinct from c.conv_id group by c.conv_id),
done as (select c.*, min(lpad((left(b.key, 8)::bigint + g.cost)::varchar, 8, '0') || b.key[9:] || g.letters) as key
    from counts c join best b on b.conv_id is not distinct from c.conv_id and b.i = c.n join gaps g on g.q = b.q and g.q2 in (0, 3) group by all),
letters as (select conv_id, p, key[8 + p] as letter from (select conv_id, key, unnest(range(1, len(key) - 7)) as p from done)),
turns as (select *, count(*) filter (letter <> 'I') over w as i, row_number() over (partition by conv_id, letter = 'D' order by p) as s from letters window w as (partition by conv_id order by p)),
on_rows as (select t.conv_id, t.p, t.s, t.letter, f.role, f.text, bool_or(t.s = 1 and t.letter = 'K' and f.initial = 's') over (partition by t.conv_id) as headed
    from turns t left join faults f on f.conv_id is not distinct from t.conv_id and f.i = t.i and t.letter <> 'I' where t.letter <> 'D'),
lines as (select conv_id, string_agg(case when letter = 'K' then role when (s - headed::int) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by p) as body from on_rows group by conv_id)
select d.conv_id, gaps, blank, duplicate, truncated, illegal, left(key, 8)::bigint as cost, key[9:] as audit, sha256(coalesce(body, '')) as repaired_sha256
from done d left join lines l on l.conv_id is not distinct from d.conv_id
"""

ORACLES = {"op11_chat_format": _ELEVEN, "op12_prefix_trie": _TWELVE, "op13_structure_repair": _THIRTEEN}
