"""Queries on the sync change feed."""

from __future__ import annotations

from corpusmith.operators.changefeed import apply_change_feed
from corpusmith.plans.registry import Registry
from corpusmith.sources.tables import table

FEED = Registry()

_NORMAL = "array_to_string(list_filter(string_split(replace({0}, '\\', '/'), '/'), lambda s: s != '' and s != '.'), '/')"

P1_SQL = f"""
with recursive sess as (select id, max(workspace_id) workspace_id, max(base_revision) rev from sync_sessions where lower(trim(status)) = 'committed' group by id),
ch as (select session_id, sequence, lower(trim(op)) op, {_NORMAL.format("path")} path, nullif({_NORMAL.format("old_path")}, '') old_path,
  lower(trim(blob_hash)) blob, row_number() over (partition by session_id, sequence order by received_at desc) n from sync_changes),
c as (select s.workspace_id ws, s.rev, ch.* from ch join sess s on s.id = ch.session_id join workspaces w on w.id = s.workspace_id and w.source_mode = 'blob' where n = 1),
ev as (
  select s.workspace_id ws, {_NORMAL.format("path")} k, -1 rev, 0 sq, 0 ph, 'set' kind, lower(blob_hash) blob, null::varchar ref from workspace_sources s join workspaces w on w.id = s.workspace_id and w.source_mode = 'blob'
  union all select ws, path, rev, sequence, 1, case op when 'delete' then 'gone' when 'upsert' then 'set' else case when blob is null then 'ref' else 'set' end end,
    case op when 'delete' then null else blob end, case when op = 'rename' and blob is null then old_path end from c
  union all select ws, old_path, rev, sequence, 0, 'gone', null, null from c where op = 'rename' and old_path is not null),
lk as (select e.ws, e.rev, e.sq, e.ph, arg_max(p.rev, (p.rev, p.sq, p.ph)) prev, arg_max(p.sq, (p.rev, p.sq, p.ph)) psq, arg_max(p.ph, (p.rev, p.sq, p.ph)) pph, e.k, e.ref
  from ev e join ev p on p.ws = e.ws and p.k = e.ref and (p.rev, p.sq, p.ph) < (e.rev, e.sq, 0) where e.kind = 'ref' group by all),
chain as (
  select ws, rev, sq, ref, prev, psq, pph, 1 hop from lk
  union all select c.ws, c.rev, c.sq, l.ref, l.prev, l.psq, l.pph, hop + 1 from chain c join lk l on l.ws = c.ws and l.rev = c.prev and l.sq = c.psq and l.ph = c.pph and l.k = c.ref),
held as (select c.ws, c.rev, c.sq, e.blob from chain c join ev e on e.ws = c.ws and e.k = c.ref and e.rev = c.prev and e.sq = c.psq and e.ph = c.pph where e.kind = 'set'),
fin as (select *, row_number() over (partition by ws, k order by rev desc, sq desc, ph desc) n from ev)
select f.ws as workspace_id, f.k as path, coalesce(f.blob, h.blob) as blob_hash
from fin f left join held h on f.kind = 'ref' and h.ws = f.ws and h.rev = f.rev and h.sq = f.sq
where n = 1 and kind != 'gone' and (kind = 'set' or h.ws is not null)
"""


@FEED.add(P1_SQL)
def p1_found(spark, directory):
    """Problem 1: the final source manifest of the ``blob`` workspaces."""
    read = lambda name: table(spark, directory, name)
    blob = read("workspaces").where("source_mode = 'blob'").selectExpr("id as workspace_id").distinct()
    base = read("workspace_sources").join(blob, "workspace_id", "left_semi")
    sessions = read("sync_sessions").join(blob, "workspace_id", "left_semi")
    return apply_change_feed(base, read("sync_changes"), sessions)
