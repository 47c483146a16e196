"""The whole search."""

from __future__ import annotations

from ..operators import score as P
from ..plans import adapters as A
from ..plans import search
from . import query
from .ledgers import AS_OF, DELTA, SUPPORT, TTL, TWO_KEY
from .rules import PACK_SQL, RANK, SCORE_SQL, pack, rank_order, score_bonus, score_parts
from .scalars import COLLAPSE, DASHED, NORM_COMPANY, TITLE_TOKENS

LIVE = f"ts > {AS_OF} - to_hours(case kind when 'seen' then 4 when 'applied' then 24 else 12 end)"


@query("search_run", f"""with recursive {TWO_KEY}, {SUPPORT}, l as (select kind, url_norm, role from decisions join k using (posting_id) where kind in ('seen', 'applied', 'dismissed') and {LIVE}),
bad as (select split_part(role, '::', 1) as company from l where kind = 'dismissed' group by 1 having count(distinct role) >= 2),
p as (select * from k where posting_id in (select posting_id from two) and url_norm not in (select url_norm from l) and role not in (select role from l where kind in ('applied', 'dismissed')) and {DASHED.format('company')} not in (select company from bad) and {PACK_SQL} is null),
x as (select posting_id, unnest({TITLE_TOKENS}) as word from p),
c as (select p.*, delta from p join {DELTA} using (posting_id)),
s2 as (select *, {SCORE_SQL.replace('least(100, greatest(0, least(100, ', 'least(100, greatest(0, least(100, delta + ', 1)} as score from c),
o as (select *, row_number() over (partition by {NORM_COMPANY.format('company')}, {COLLAPSE.format('lower(split_part(title, ' + repr('|') + ', 1))')} order by {RANK}) as i from s2)
select posting_id, title, company, score, delta, url_norm in (select url_norm from decisions join k using (posting_id) where kind = 'sent') as sent from o where i = 1 order by {RANK} limit 20""", "postings", "decisions")
def _(spark, d):
    def score(delta):
        return P.final_score(score_parts() | {"preference": delta}, score_bonus())[0]

    best = search.run(A.postings(spark, d), A.decisions(spark, d), pack(), score, A.as_of(), TTL, rank_order(), 20)
    return best.select("posting_id", "title", "company", "score", "delta", "sent")
