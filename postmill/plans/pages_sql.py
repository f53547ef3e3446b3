"""Deterministic listing and detail pages over the star-schema test tables, in SQL.

A page says its facts in marked elements, in one JSON-LD object, or in a list of them, by the
remainder of the order key; ``facts`` holds what a reader should find
(that part DuckDB runs too).
"""

_DATE = "cast(cast(o_orderdate as date) as string)"

FACTS = f"""
    select o_orderkey as id, o_orderkey % 3 as shape,
        'Title ' || cast(o_custkey % 50 as string) as title, 'Firm ' || cast(o_orderkey % 40 as string) as company,
        case o_orderkey % 4 when 0 then 'Riyadh' when 1 then 'Jeddah' when 2 then 'Dammam' else 'Tabuk' end as city,
        {_DATE} as posting_date,
        case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 1 then 'Full Time' else 'Contract' end as employment_type,
        case when o_orderkey % 7 = 0 then 'Remote' when o_orderkey % 7 = 1 then 'Hybrid' end as work_mode,
        case when o_orderkey % 6 = 0 then null else cast(1 + o_orderkey % 6 as string) || ' years' end as experience,
        case when o_orderkey % 8 = 0 then null else 'any' end as gender,
        cast(1000 + o_orderkey % 900 as string) as low, cast(3000 + o_orderkey % 900 as string) as high, o_orderkey % 9 as pay,
        'What the work of number ' || cast(o_orderkey as string) || ' is about, at some length' as about
    from orders
"""

_JSON = (
    "'{\"@type\":\"JobPosting\",\"title\":\"' || title || '\",\"datePosted\":\"' || posting_date || '\",\"hiringOrganization\":{\"name\":\"' || company || '\"},"
    "\"jobLocation\":{\"address\":{\"addressLocality\":\"' || city || '\"}},\"description\":\"' || case when id % 2 = 0 then '<p>' || about || '</p>' else '<b>short</b>' end || '\",\"baseSalary\":{\"currency\":\"SAR\",\"value\":{'"
    " || case when pay < 3 then '\"minValue\":' || low || ',\"maxValue\":' || high when pay < 5 then '\"minValue\":' || low else '' end || '}}}'"
)

PAGES = f"""
select id, '<html><body><h1>page</h1>'
    || case shape when 0 then '<div class="box job-title-text">' || title || '</div><a class="job-meta-company"><b>' || company || '</b></a>'
        || '<span class="job-meta-item">Dept, Mecca</span><span class="job-meta-item">Dept,  ' || city || '</span>' || case when id % 5 = 0 then '<span class="job-meta-item">Saudi Arabia</span>' else '' end
        || '<i class="job-date" data-datetime="' || posting_date || '">x</i><script type="application/ld+json">' || '{{"@type":"JobPosting","title":"other","baseSalary":{{"value":{{}}}}}}' || '</script>'
      when 1 then '<script type="application/ld+json">' || {_JSON} || '</script>'
      else '<script type="application/ld+json">[{{"@type":"Thing","title":"no"}},' || {_JSON} || ']</script>' end
    || '<span class="job-tag">Show original</span>' || case when employment_type is null then '' else '<span class="job-tag">Internship</span><span class="job-tag">' || employment_type || '</span>' end
    || case when work_mode is null then '' else '<span class="job-tag">' || work_mode || '</span>' end
    || '<dl class="meta-data">' || case when experience is null then '' else '<dt>Experience</dt><dd>' || experience || '</dd>' end || case when gender is null then '' else '<dt>Gender</dt><dd>' || gender || '</dd>' end
    || case when pay = 8 then '<dt>Salary</dt><dd>5000 a month</dd>' else '' end || '<dt>Nothing</dt></dl>'
    || '<section class="text-html"><p>' || about || ' &amp; more</p></section>'
    || '<a href="/j/0' || cast((id * 3 + 1) % 400 as string) || '.html">1</a><a href="/j/0' || cast((id * 5 + 2) % 400 as string) || '.html">2</a></body></html>' as html
from facts
"""

#: Detail pages whose elements hold others of the same name, with comments, scripts and unclosed items in them.
NESTED_PAGES = """
select id, '<html><body><div class="page"><div class="head job-title-text"><div>' || title || '<!-- </div> --></div><script>"</div></div>"</script><div> (m/f)</div></div>'
    || '<div class=job-meta-company><div><div>' || company || '</div></div></div><ul><li class="job-meta-item">Dept, Mecca<li class="job-meta-item">Dept, <span><span>' || city || '</span></span></ul>'
    || '<div class="meta-data"><div><div>Experience</div><div><div>' || coalesce(experience, 'none') || '</div></div></div></div>'
    || '<div class="ltr text-html"><div><div>' || about || '</div></div><div><p>one<p title="</div>">two &amp; three</div>end</div><div>after</div>'
    || '<ul class="my-skills"><li>a &#38; b<li>c<li>d</ul><a class="btn apply-btn" href="#" data-url="/apply/' || id || '">Apply</a>'
    || '<section class="site"><section>Riyadh</section></section><section class="site"><br>' || city || '<br></section></div></body></html>' as html
from facts
"""

#: One listing page for every hundred orders: ids in attributes and in links, some twice.
LISTINGS = """
select page, '<ul>' || array_join(array_sort(collect_list('<li data-job-id="' || lpad(cast(k as string), 9, '0') || '"><a href="/x/0' || cast(k as string) || '.html">a</a><a href="/x/0' || cast(k % 50 as string) || '.html">b</a></li>')), '') || '</ul>' as html
from (select cast(floor(o_orderkey / 100) as bigint) as page, o_orderkey as k from orders) group by page
"""
