"""DuckDB SQL twins of the registered queries that SQL can express."""

from __future__ import annotations

#: A word as DuckDB's regular expressions write it.
_WORD = r"[^\x20\x09-\x0D]+"
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_MIX = rf"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size
  from documents
), sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as number
  from sized group by source
), weighed as (
  select *, [5, 2, 1][(number % 3) + 1] as weight, source_size * 2 as most,
    source_size * 2 / [5, 2, 1][(number % 3) + 1] as stop
  from sources
), levels as (
  select *, (sum(source_size) over () * 1.5::double
      - coalesce(sum(most) over (order by stop, number rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by stop, number rows between current row and unbounded following) as level
  from weighed
), targets as (
  select source, source_size, number,
    case when level >= stop then most::double
      else weight * max(case when level < stop then level end) over () end as target
  from levels
), total as (
  select sum(target) as total, greatest(1, least(1024, floor(sum(target))::bigint // 131072)) as block from targets
), edges as (
  select number, coalesce(lag(high) over (order by number), 0) as low, high
  from (
    select number, case when number = max(number) over () then 2147483648
      else floor(sum(target) over (order by number) / (select total from total) * 2147483648)::bigint end as high
    from targets
  )
), slots as (
  select slot, slot * 1327217885 % 2147483648 as point
  from range((select case when total > 0 then ceil(total / block)::bigint else 0 end from total)) t(slot)
), ranks as (
  select number, row_number() over (partition by number order by slot) - 1 as rank
  from slots join edges on point >= low and point < high
), filled as (
  select number, count(*) * (select block from total) as words from ranks group by number
), passes as (
  select doc_id, number, source_size, target, size, epoch,
    ('0x' || substr(md5(epoch || ':' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as place
  from sized join targets on sized.source is not distinct from targets.source, (values (0), (1)) e(epoch)
  where size > 0 and (epoch = 0 or target > source_size)
), streams as (
  select *, epoch * source_size + coalesce(sum(size) over (
    partition by number, epoch order by place, doc_id rows between unbounded preceding and 1 preceding), 0) as start
  from passes
), taken as (
  select doc_id, sum(greatest(0, least(size, words - start)))::bigint as taken
  from streams join filled using (number) group by doc_id
)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken
from sized join targets on sized.source is not distinct from targets.source left join taken using (doc_id)
"""

#: Four statistics, each with its least standard deviation.
_FLOORS = [0.07, 0.6, 0.6, 1.0]


def _double(value: float) -> str:
    return f"{value!r}::double"


def _distance() -> str:
    """The squared Mahalanobis distance by forward substitution."""
    solved = []
    for i in range(4):
        rest = "".join(f" - l{i}{j} * ({solved[j]})" for j in range(i))
        solved.append(f"(x{i} / 1000::double - m{i}{rest}) / l{i}{i}")
    return " + ".join(f"({y}) * ({y})" for y in solved)


def _robust(steps: int = 4) -> str:
    """Base counts, concentration steps from medians on, and the verdict."""
    pairs = [(i, j) for i in range(4) for j in range(i + 1)]
    factor = ", ".join(f"l{i}{j}" for i, j in pairs)
    same = "k1 is not distinct from e.k1 and r.k2 is not distinct from e.k2"
    start = ", ".join(f"quantile_cont(x{i}, 0.5) / 1000::double as m{i}" for i in range(4))
    floors = ", ".join(f"{_double(_FLOORS[i] if i == j else 0.0)} as l{i}{j}" for i, j in pairs)
    sums = ", ".join(
        [f"sum(x{i})::double as s{i}" for i in range(4)]
        + [f"sum(x{i}::hugeint * x{j})::double as s{i}{j}" for i, j in pairs]
    )
    means = ", ".join(f"s{i} / n / 1000::double as m{i}" for i in range(4))
    spread = []
    for i, j in pairs:
        own = f"(s{i}{j} / n - s{i} / n * (s{j} / n)) / 1000000::double * {_double(2.1146)}"
        own = f"greatest({own}, 0::double) + {_double(_FLOORS[i] * _FLOORS[i])}" if i == j else own
        spread.append(f"{own} as c{i}{j}")
    parts = [f"estimate0 as (select k1, k2, {start}, {floors} from good group by k1, k2)"]
    for step in range(steps):
        parts.append(f"""far{step} as (
  select r.*, floor(sqrt({_distance()}) * 64)::bigint as bin from good r join estimate{step} e on r.{same}
), bound{step} as (select k1, k2, quantile_cont(bin, 0.5) as most from far{step} group by k1, k2
), sums{step} as (
  select r.k1, r.k2, count(*)::double as n, {sums}
  from far{step} r join bound{step} e on r.{same} where bin <= most group by r.k1, r.k2
), spread{step} as (select k1, k2, {means}, {', '.join(spread)} from sums{step})""")
        last = f"spread{step}"
        for i, j in pairs:  # one expression each, as a column is named only one select later
            rest = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            value = f"sqrt(c{i}{j}{rest})" if i == j else f"(c{i}{j}{rest}) / l{j}{j}"
            parts.append(f"factor{step}_{i}{j} as (select *, {value} as l{i}{j} from {last})")
            last = f"factor{step}_{i}{j}"
        parts.append(f"estimate{step + 1} as (select k1, k2, m0, m1, m2, m3, {factor} from {last})")
    return f"""
with docs as materialized (
  select row_number() over () as rid, doc_id, lang as k1, source as k2, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '{_WORD}') as words
  from documents
), windows as materialized (
  select rid, i, array_to_string(words[i:i + 7], ' ') as w
  from (select rid, words, unnest(range(1, len(words) - 6)) as i from docs where len(words) >= 8)
), repeats as (
  select rid, count(distinct i + k) as n
  from windows join (select rid, w from windows group by rid, w having count(*) > 1) using (rid, w),
    range(0, 8) t(k)
  group by rid
), counted as (
  select docs.rid, doc_id, k1, k2, len(words)::bigint as n_words,
    length(translate(text, {_SPACES}, ''))::bigint as word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
    (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))))::bigint
      as n_dup_lines,
    coalesce(repeats.n, 0)::bigint as n_repeat_words
  from docs left join repeats using (rid)
), marked as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counted
), good as materialized (
  select rid, k1, k2, round(ln(word_chars / n_words) * 1000)::bigint as x0,
    round(ln(1 + 100 * n_symbols / n_words) * 1000)::bigint as x1,
    round(ln(1 + 100 * n_dup_lines / n_words) * 1000)::bigint as x2,
    round(ln(1 + 100 * n_repeat_words / n_words) * 1000)::bigint as x3
  from marked where not base_failed
), {', '.join(parts)}, kept as (
  select rid from good r join estimate{steps} e on r.{same} where {_distance()} <= {_double(23.513)}
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.rid is not null as kept
from marked left join kept using (rid)
"""


#: The crc32 of a text in ASCII, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split({0}, ''),
  lambda ch: list_transform(range(8), lambda i: ((ascii(ch) >> i::int) & 1)::bigint)))),
  lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"""


def _least(*edits: tuple[str, str, int, str, str]) -> str:
    """The first of the edits ``(condition, letter, cost, line, state after)`` by cost, then letters."""
    found = ", ".join(
        f"{{'cost': {then}.cost + {cost} + (case when {can} then 0 else 1000000 end),"
        f" 'audit': '{letter}' || {then}.audit, 'lines': {line} || {then}.lines}}"
        for can, letter, cost, line, then in edits
    )
    return f"list_sort([{found}])[1]"


def _turn_edits(state: int) -> str:
    gone, stays = "fault in ('blank', 'duplicate')", "(fault = 'truncated')::int"
    after = {0: 2, 1: 2, 2: 3, 3: 2}[state]
    role = {2: "user", 3: "assistant"}[after]
    edits = [
        ("true", "D", 3, "''", f"s{state}"),
        (f"not {gone}", "R", f"2 + {stays}", f"chr(10) || '{role}:' || text", f"s{after}"),
        (f"not {gone} and left(role, 1) = '{role[0]}'", "K", stays, "chr(10) || role || ':' || text", f"s{after}"),
    ]
    if state == 0:
        edits.append((f"not {gone} and left(role, 1) = 's'", "K", stays, "chr(10) || role || ':' || text", "s1"))
    return _least(*edits)


_END = "{{'cost': {}::bigint, 'audit': '{}', 'lines': {}}}"

_CONVERSATIONS = f"""
with recursive coded as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {_CRC32.format("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as c
  from conversations
), hurt as (
  select conv_id, turn, case when c = 4 then 'user' else role end as role,
    case when c = 1 then '' when c = 2 then translate(text, '.!?', '') else text end as text
  from coded, unnest(case when c = 0 then [] when c = 3 then [1, 2] else [1] end) as u(copy)
), told as (
  select *, row_number() over (partition by conv_id, role, text order by turn nulls first) as seen from hurt
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, seen) as n from told
), marked as (
  select *, coalesce(case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank' when seen > 1 then 'duplicate'
      when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then 'truncated' end, '') as fault,
    lag(left(role, 1)) over (partition by conv_id order by n) as before
  from placed
), counted as (
  select conv_id, max(n) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count_if(fault = 'blank') as blank, count_if(fault = 'duplicate') as duplicate,
    count_if(fault = 'truncated') as truncated,
    count_if(before || left(role, 1) not in ('su', 'ua', 'au')) as illegal
  from marked group by conv_id
), steps as (
  select conv_id, n, {_END.format(0, "", "''")} as s0,
    {_END.format(4, "II", "chr(10) || 'user:' || chr(10) || 'assistant:'")} as s1,
    {_END.format(2, "I", "chr(10) || 'assistant:'")} as s2, {_END.format(0, "", "''")} as s3
  from counted
  union all
  select conv_id, n,
    {_least(("true", "", 0, "''", "b0"), ("true", "I", 2, "chr(10) || 'user:'", "b2"))},
    {_least(("true", "", 0, "''", "b1"), ("true", "I", 2, "chr(10) || 'user:'", "b2"))},
    {_least(("true", "", 0, "''", "b2"), ("true", "I", 2, "chr(10) || 'assistant:'", "b3"))},
    {_least(("true", "", 0, "''", "b3"), ("true", "I", 2, "chr(10) || 'user:'", "b2"))}
  from (
    select steps.conv_id, steps.n - 1 as n, {", ".join(f"{_turn_edits(i)} as b{i}" for i in range(4))}
    from steps join marked on steps.conv_id is not distinct from marked.conv_id and steps.n = marked.n
  )
)
select k.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank,
  coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(s0.cost, 0)::bigint as cost, coalesce(s0.audit, '') as audit,
  sha256(substr(coalesce(s0.lines, ''), 2)) as repaired_sha256
from (select distinct conv_id from conversations) k
left join counted on k.conv_id is not distinct from counted.conv_id
left join steps on k.conv_id is not distinct from steps.conv_id and steps.n = 0
"""

def _nearest(number: int) -> str:
    """Squared distances to the centroids of a round, and the nearest of each vector."""
    return f"""near{number} as (
  select v.rid, arg_min(c.i, d * 64 + c.i) as cluster, min(d) as distance
  from cells v, centroids{number} c, lateral (
    select list_sum(list_transform(range(1, 65), lambda j: (v.x[j] - c.x[j]) * (v.x[j] - c.x[j])))::bigint as d
  )
  group by v.rid
)"""


def _lloyd(rounds: int = 3) -> str:
    parts = []
    for i in range(rounds):
        parts.append(_nearest(i))
        parts.append(f"""centroids{i + 1} as (
  select c.i, coalesce(m.x, c.x) as x from centroids{i} c left join (
    select cluster, list(mean order by j) as x from (
      select cluster, j, case when sum(x[j]) >= 0 then sum(x[j])::bigint // count(*) else -((count(*) - 1 - sum(x[j])::bigint) // count(*)) end as mean
      from near{i} join cells using (rid), range(1, 65) r(j) group by cluster, j
    ) group by cluster
  ) m on m.cluster = c.i
)""")
    parts.append(_nearest(rounds))
    return f"""
with numbered as (select row_number() over () as rid, vec_id, embedding from embeddings), cells as (
  select rid, vec_id, list_transform(embedding, lambda e: floor(e::double * 64)::bigint) as x from numbered
  where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is not null and isfinite(e::double))) = 64
), centroids0 as (
  select row_number() over (order by sha256('1:' || coalesce(vec_id::varchar, '')), x) - 1 as i, x from cells
  qualify i < 16
), {", ".join(parts)}
select vec_id, cluster::int as cluster, distance,
  (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia,
  sha256(array_to_string(centroids{rounds}.x, ',')) as centroid_sha256
from near{rounds} join cells using (rid) join centroids{rounds} on centroids{rounds}.i = cluster
"""


ORACLES: dict[str, str] = {
    "op4_robust_outliers": _robust(), "op6_source_mix": _MIX, "op11_streamed_repair": _CONVERSATIONS,
    "op13_sharded_lloyd": _lloyd(),
}
