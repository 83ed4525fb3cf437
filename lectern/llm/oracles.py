"""DuckDB SQL of the contract queries that SQL can express."""

from __future__ import annotations

_WORDS = r"d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents)"


def _windows(m: int) -> str:
    """Windows of m words that occur twice in their document, and the words they cover."""
    return f"""win{m} as (select doc_id, i, array_to_string(w[i:i + {m - 1}], ' ') as k from d, unnest(range(1, greatest(1, len(w) - {m} + 2))) as t(i)),
    rep{m} as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as c from win{m}) where c > 1),
    cov{m} as (select doc_id, count(distinct i + j) as n from rep{m}, unnest(range({m})) as u(j) group by doc_id)"""


OP2 = f"""with {_WORDS}, {_windows(5)}, {_windows(8)}, {_windows(31)},
base as (
  select d.doc_id, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) as bigint) as n_dup_lines,
    coalesce(cov5.n, 0) as n_repeat_words, coalesce(cov8.n, 0) as n8, coalesce(cov31.n, 0) as n31
  from d left join cov5 on cov5.doc_id = d.doc_id left join cov8 on cov8.doc_id = d.doc_id left join cov31 on cov31.doc_id = d.doc_id),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and n8 <= 0.18 * n_words and n31 = 0 as kept from judged"""

OP6 = f"""with {_WORDS},
win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as k from d, unnest(range(1, greatest(1, len(w) - 11))) as t(i)),
least_id as (select k, min(doc_id) as f from win group by k),
lost as (select distinct doc_id, i + j as p from win join least_id using (k), unnest(range(13)) as u(j) where f < doc_id),
words as (select doc_id, p, w[p] as word from d, unnest(range(1, len(w) + 1)) as t(p)),
kept as (select words.doc_id, string_agg(word, ' ' order by words.p) as text, count(*) as n from words left join lost on lost.doc_id = words.doc_id and lost.p = words.p where lost.p is null group by words.doc_id)
select d.doc_id, len(w) as n_words, len(w) - coalesce(kept.n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from d left join kept on kept.doc_id = d.doc_id"""

OP9 = """with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as h from pages),
k as (select h, max(page_id) as keeper from p where n >= 1000 group by h)
select page_id, cast(n as bigint) as payload_bytes, p.h as payload_digest, case when page_id < keeper then 'revisit' else 'response' end as record_type,
  case when page_id < keeper then keeper end as refers_to, true as verified from p left join k on k.h = p.h and n >= 1000"""

SQL = {"op2_repetition": OP2, "op6_suffix_automata": OP6, "op9_warc": OP9}
