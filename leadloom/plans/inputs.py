"""Campaign-like tables derived from the general test tables.

Each view keeps every row of the table it starts from.  A third of the leads,
people, addresses and pages fall to one domain, so every plan meets a hot key.
The text is plain SQL; `<<name>>` refers to a table or another view.
"""

AS_OF = "2024-03-01 00:00:00"


def _domain_number(key: str) -> str:
    return f"(CASE WHEN {key} % 3 = 0 THEN 1 ELSE 2 + {key} % 700 END)"


def _domain(n: str) -> str:
    return (
        f"concat('c', {n}, CASE WHEN {n} = 1 THEN '.com' WHEN {n} % 8 = 0 THEN '.com' WHEN {n} % 8 = 1 THEN '.co.uk' "
        f"WHEN {n} % 8 = 2 THEN '.de' WHEN {n} % 8 = 3 THEN '.com.au' WHEN {n} % 8 = 4 THEN '.ca' "
        f"WHEN {n} % 8 = 5 THEN '.io' WHEN {n} % 8 = 6 THEN '.co.in' ELSE '.fr' END)"
    )


def _email(key: str) -> str:
    return f"concat('u', {key}, '@', {_domain(_domain_number(key))})"


def _floor(value: str, by: int) -> str:
    return f"CAST(floor({value} / {by}) AS BIGINT)"


def _minutes(start: str, count: str) -> str:
    return f"(CAST('{start}' AS TIMESTAMP) + ({count}) * INTERVAL '1' MINUTE)"


_FIRST = "jane,john,mary,peter,laura,oscar,nina,adam,ruth,carl,elsa,hugo"
_LAST = "diaz,smith,brown,fried,levi,meyer,novak,olsen,perez,quinn,reyes,stone,turner,urban,vogel,weber,young"
#: Hosts under wildcard and exception rules, under long and new suffixes, in other scripts, and under no suffix at all.
_ODD_HOSTS = (
    "www.acme.com.ua,shop.acme.co.ck,www.ck,a.www.ck,acme.gg,acme.bank,bit.ly,x.acme.foo.kawasaki.jp,a.city.kawasaki.jp,foo.kawasaki.jp,"
    "acme.pvt.k12.ma.us,www.acme.com.pl,acme.xn--p1ai,www.acme.рф,acme.unlisted,com.ua"
)
_TITLES = (
    "Founder,CEO,Head of Sales,Engineer,VP of Marketing,Director,Analyst,Co-Founder,Sales Manager,Chief Data Officer,"
    "Vice President,Advocate,Marketing Manager"
)


def _pick(items: str, at: str) -> str:
    n = len(items.split(","))
    return f"split_part('{items}', ',', CAST(1 + ({at}) % {n} AS INT))"


def _letter(value: str) -> str:
    return f"chr(CAST(97 + ({value}) % 26 AS INT))"


def _safe(text: str) -> str:
    """Text without quotes, backslashes and line breaks, fit for JSON."""
    return f"translate({text}, concat('\"', chr(10), chr(92)), '   ')"


VIEWS = {
    # ---------------------------------------------------------------- leads
    "v_keys": f"""
        SELECT c_custkey AS k, {_domain_number('c_custkey')} AS n,
               {_domain(_domain_number('c_custkey'))} AS domain,
               {_email('c_custkey')} AS email,
               c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment
        FROM <<customer>>""",
    "v_leads_raw": f"""
        SELECT k AS pos, name AS company, segment,
               CASE WHEN k % 41 = 7 THEN '   '
                    WHEN k % 43 = 5 THEN 'localhost'
                    WHEN k % 47 = 3 THEN concat('HTTP://WWW.', upper(domain))
                    WHEN k % 53 = 2 THEN concat('http://user:pw@192.168.', k % 200, '.1/x')
                    WHEN k % 59 = 4 THEN concat('https://', {_pick(_ODD_HOSTS, _floor('k', 59))}, '/x')
                    WHEN k % 5 = 0 THEN concat(domain, '/a?ref=1&id=', k)
                    WHEN k % 5 = 1 THEN concat(' https://www.', domain, '/?utm_source=x&id=', k, '&q=a+b%20c')
                    WHEN k % 5 = 2 THEN concat('http://Shop.', upper(domain), ':8080/p?UTM_Campaign=z&fbclid=1#frag')
                    WHEN k % 5 = 3 THEN concat('https://me@', domain, './path?keep=&x=~a*b&Ref=2')
                    ELSE concat('https://', domain, '/about') END AS website
        FROM <<v_keys>>""",
    "v_dns": """
        SELECT domain, n,
               CASE WHEN n % 10 <> 0 THEN 10 + n % 20 END AS mx_pref1,
               CASE WHEN n % 10 <> 0 THEN concat('mx', n % 3, '.', domain) END AS mx_host1,
               CASE WHEN n % 10 <> 0 AND n % 2 = 0 THEN 15 END AS mx_pref2,
               CASE WHEN n % 10 <> 0 AND n % 2 = 0 THEN concat('alt.', domain) END AS mx_host2,
               CASE WHEN n % 17 = 0 THEN 'NS1.SedoParking.com.' ELSE concat('ns1.', domain, '.') END AS ns1,
               CASE WHEN n % 19 = 0 THEN 'b.bodis.com' ELSE concat('ns2.', domain) END AS ns2,
               CASE WHEN n % 4 = 0 THEN concat('v=spf1 include:_spf.', domain, ' ~all') ELSE concat('site=', n) END AS txt1,
               CASE WHEN n % 6 = 1 THEN 'v=spf1 -all' ELSE concat('other=', n) END AS txt2,
               CASE WHEN n % 5 = 0 THEN 'v=DMARC1; p=reject; pct=100' WHEN n % 5 = 1 THEN 'v=DMARC1; rua=x'
                    WHEN n % 5 = 2 THEN 'v=DMARC1; p=none' ELSE 'none' END AS dmarc1,
               CASE WHEN n % 3 = 0 THEN 'k1' WHEN n % 3 = 1 THEN 'custom' ELSE 'google' END AS dkim1,
               CASE WHEN n % 2 = 0 THEN 'default' ELSE 'zz' END AS dkim2,
               concat('10.', n % 200, '.', n % 7, '.1') AS ip,
               n % 6 = 0 AS catch_all
        FROM (SELECT domain, n FROM <<v_keys>> GROUP BY domain, n) d""",
    "v_dnsbl": """
        SELECT ip, CASE WHEN n % 3 = 0 THEN 'zen.spamhaus.org' WHEN n % 3 = 1 THEN 'dnsbl.sorbs.net'
                        ELSE 'b.barracudacentral.org' END AS zone,
               n % 4 = 1 AS listed
        FROM <<v_dns>>""",
    "v_suppression": """
        SELECT value, scope, min(reason) AS reason, min(suppressed_at) AS suppressed_at
        FROM (SELECT CASE WHEN k % 2 = 0 AND n <> 1 THEN domain ELSE email END AS value,
                     CASE WHEN k % 2 = 0 AND n <> 1 THEN 'domain' ELSE 'email' END AS scope,
                     CASE WHEN k % 4 = 0 THEN 'bounced' ELSE 'unsubscribed' END AS reason,
                     (CAST('2024-01-01 00:00:00' AS TIMESTAMP) + k * INTERVAL '1' MINUTE) AS suppressed_at
              FROM <<v_keys>> WHERE balance < 0) s
        GROUP BY value, scope""",
    "v_leads": f"""
        SELECT email, domain, name, CAST(k % 4 AS INT) AS sequence_step,
               CASE WHEN k % 10 = 0 THEN 'replied' WHEN k % 10 = 1 THEN 'bounced' WHEN k % 10 = 2 THEN 'unsubscribed'
                    WHEN k % 10 = 3 THEN 'completed' ELSE 'active' END AS status,
               {_minutes('2024-02-01 00:00:00', 'k')} AS last_sent_at,
               CASE WHEN k % 3 = 1 THEN {_minutes('2024-02-20 00:00:00', '1440 * (k % 20)')} END AS next_send_at,
               {_minutes('2024-01-01 00:00:00', '100000 - k')} AS created_at,
               {_minutes('2024-02-02 00:00:00', 'k')} AS updated_at,
               CAST(NULL AS TIMESTAMP) AS meeting_booked_at
        FROM <<v_keys>>""",
    # ----------------------------------------------------------- sends, mail
    "v_send_log": f"""
        SELECT o_orderkey AS id, {_email('o_custkey')} AS email, CAST(1 + o_orderkey % 4 AS INT) AS step,
               concat(CASE WHEN o_orderkey % 7 = 1 THEN 'Re: ' WHEN o_orderkey % 7 = 2 THEN ' RE: re:  ' ELSE '' END,
                      CASE WHEN o_orderkey % 5 = 0 THEN 'Quick question' WHEN o_orderkey % 5 = 1 THEN 'quick question '
                           WHEN o_orderkey % 5 = 2 THEN 'your launch' WHEN o_orderkey % 5 = 3 THEN 'reducing churn'
                           ELSE 'regarding hiring' END) AS subject,
               concat('<m', o_orderkey, '@send>') AS message_id,
               concat(lower(substr(o_orderpriority, 1, 1)), '@box', '.io') AS mailbox,
               (CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 1440) * INTERVAL '1' MINUTE) AS sent_at,
               CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'sent' END AS status
        FROM <<orders>>""",
    "v_replies": f"""
        SELECT conv_id * 1000 + turn AS id, {_email('(conv_id * 3 + turn)')} AS email, CAST(1 + turn % 4 AS INT) AS step,
               'Re: quick question' AS subject, text AS body_text,
               {_minutes('2024-02-01 00:00:00', 'conv_id * 10 + turn')} AS received_at,
               CASE WHEN (conv_id + turn) % 4 = 0 THEN 'positive' WHEN (conv_id + turn) % 4 = 1 THEN 'negative'
                    WHEN (conv_id + turn) % 4 = 2 THEN 'neutral' END AS sentiment
        FROM <<conversations>>""",
    "v_reply_answers": """
        SELECT id,
               CASE WHEN id % 11 = 0 THEN 'not json'
                    WHEN id % 3 = 0 THEN concat('```json', chr(10), '{"sentiment": "positive", "confidence": ', 1 + id % 10, CASE WHEN id % 4 = 1 THEN '.5' ELSE '' END, '}', chr(10), '```')
                    WHEN id % 3 = 1 THEN concat('{"confidence": ', 1 + id % 10, ', "reasoning": "unclear"}')
                    ELSE concat(' {"sentiment": "negative", "confidence": ', 1 + id % 10, '} ') END AS raw_text,
               CASE WHEN id % 13 = 5 THEN '503 overloaded' END AS error
        FROM <<v_replies>>""",
    "v_inbound": f"""
        SELECT lpad(CAST(conv_id * 1000 + turn AS STRING), 12, '0') AS uid,
               CASE WHEN conv_id % 6 = 0 THEN concat('Mail Delivery <MAILER-DAEMON@mail.', domain, '>')
                    WHEN conv_id % 6 = 1 THEN concat('stranger', conv_id, '@nowhere.org')
                    WHEN conv_id % 6 = 2 THEN concat(' ', upper(email), ' ')
                    ELSE concat('"U. Ser" <', email, '>') END AS from_addr,
               CASE WHEN conv_id % 6 = 0 AND turn % 2 = 0 THEN 'Undelivered Mail Returned to Sender'
                    WHEN conv_id % 6 = 0 THEN 'Delivery Status Notification (Delay)'
                    WHEN conv_id % 12 = 3 THEN 'Automatic reply: hello'
                    ELSE 'Re: quick question' END AS subject,
               concat(text, ' ',
                      CASE WHEN conv_id % 6 = 0 THEN concat('to ', email, CASE WHEN turn % 3 = 0 THEN ': 550 5.1.1 user unknown'
                              WHEN turn % 3 = 1 THEN ': 450 4.2.2 mailbox full, try again later' ELSE ': no idea' END)
                           WHEN conv_id % 6 = 1 AND turn % 2 = 0 THEN 'ask nobody@nowhere.org'
                           WHEN conv_id % 6 = 1 THEN concat('please ask nobody@nowhere.org or ', upper(email))
                           WHEN (conv_id + turn) % 7 = 0 THEN 'Please unsubscribe me, not interested.'
                           WHEN (conv_id + turn) % 7 = 1 THEN 'I am out of the office, back on 12/25/2026.'
                           WHEN (conv_id + turn) % 7 = 2 THEN 'On vacation. Returning Dec 25 at the latest'
                           WHEN (conv_id + turn) % 7 = 3 THEN 'Currently away indefinitely'
                           WHEN (conv_id + turn) % 7 = 4 THEN 'annual leave, back 02/29 or so'
                           ELSE 'Interested, tell me more.' END) AS body,
               CASE WHEN conv_id % 18 = 0 THEN 'Status: 4.2.2' WHEN conv_id % 18 = 6 THEN 'Status: 5.1.1' ELSE '' END AS dsn,
               {_minutes('2024-02-10 00:00:00', '(conv_id * 7919 + turn * 1117) % 28000')} AS received_at
        FROM (SELECT conv_id, turn, text, {_domain(_domain_number('(conv_id * 3 + turn)'))} AS domain,
                     {_email('(conv_id * 3 + turn)')} AS email FROM <<conversations>>) m""",
    "v_processed": """
        SELECT uid, 'reply' AS classification FROM <<v_inbound>> WHERE received_at < CAST('2024-02-12 00:00:00' AS TIMESTAMP)""",
    "v_lead_events": f"""
        SELECT {_email('user_id')} AS email,
               CASE WHEN event_type = 'purchase' THEN 'replied' WHEN event_type = 'error' THEN 'bounced'
                    WHEN event_type = 'signup' THEN 'unsubscribed' WHEN event_type = 'click' THEN 'rescheduled'
                    WHEN event_id % 50 = 0 THEN 'meeting' ELSE 'sent' END AS kind,
               CAST(ts AS TIMESTAMP) AS ts, lpad(CAST(event_id AS STRING), 20, '0') AS seq,
               CAST(1 + event_id % 4 AS INT) AS step,
               (CAST('2024-03-01 00:00:00' AS TIMESTAMP) + (event_id % 30) * INTERVAL '1' DAY) AS value_at
        FROM <<events>>""",
    "v_mailboxes": """
        SELECT concat(n_nationkey, '@box.io') AS name, CAST(n_nationkey AS BIGINT) AS pos,
               concat(lower(n_name), '@c', 1 + n_nationkey * 3, '.com') AS smtp_user,
               CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE concat('reply', n_nationkey, '@box.io') END AS reply_to,
               CASE WHEN n_nationkey % 2 = 0 THEN concat('Sender ', n_nationkey) ELSE '' END AS from_name,
               CAST(CAST('2024-03-01 00:00:00' AS TIMESTAMP) - n_nationkey * INTERVAL '1' DAY AS DATE) AS warmup_start_date,
               CASE WHEN n_nationkey % 6 = 5 THEN 3 WHEN n_nationkey % 11 = 10 THEN 0 END AS daily_cap_override
        FROM <<nation>>""",
    "v_counts_today": """
        SELECT name AS mailbox, pos % 7 AS count FROM <<v_mailboxes>>""",
    # ----------------------------------------------------------- queue, gate
    "v_queue": f"""
        SELECT pos, to_email, to_name, domain, subject, body, step
        FROM (SELECT doc_id AS pos, k,
                     CASE WHEN doc_id % 9 = 0 THEN concat(' ', upper(email), ' ') ELSE email END AS to_email,
                     concat('Lead ', k) AS to_name,
                     CASE WHEN doc_id % 10 = 0 THEN '' ELSE domain END AS domain,
                     CASE WHEN doc_id % 29 = 0 THEN 'hello {{{{first_name}}}}' WHEN doc_id % 31 = 0 THEN 'dear NAME, null'
                          ELSE concat('idea ', doc_id % 5) END AS subject,
                     concat(text,
                            CASE WHEN doc_id % 11 = 0 THEN ' Visit https://x.io now.' WHEN doc_id % 11 = 1 THEN ' {{{{first_name}}}}.'
                                 WHEN doc_id % 11 = 2 THEN ' Just Following Up on synergy.' WHEN doc_id % 11 = 3 THEN ' <img src=x>'
                                 WHEN doc_id % 11 = 4 THEN ' As an AI I don’t have access, undefined.'
                                 WHEN doc_id % 11 = 5 THEN ' ![a](b) [[x]]' ELSE '' END) AS body,
                     CAST(CASE WHEN doc_id % 37 = 5 THEN 4 ELSE 1 + doc_id % 4 END AS INT) AS step
              FROM (SELECT doc_id, text, {_floor('doc_id', 4)} AS k,
                           {_domain(_domain_number(_floor('doc_id', 4)))} AS domain,
                           {_email(_floor('doc_id', 4))} AS email
                    FROM <<documents>>) d) q""",
    "v_queue_keyed": """
        SELECT pos, to_email, to_name, subject, body, step,
               CASE WHEN domain = '' THEN split_part(to_email, '@', -1) ELSE domain END AS domain,
               lower(trim(to_email)) AS email_key
        FROM <<v_queue>>""",
    "v_facts": f"""
        SELECT domain, n,
               CASE WHEN n % 9 = 0 THEN '' ELSE {_safe("substr(h.text, 1, 60)")} END AS hook_quote,
               concat('hook about ', substr(domain, 1, 4)) AS hook,
               {_safe("substr(h.text, 20, 12)")} AS pain_quote,
               'growing pains' AS pain,
               n % 5 AS claims
        FROM (SELECT domain, n, n % (SELECT count(*) FROM <<benchmark>>) AS item FROM <<v_dns>>) d
        JOIN <<benchmark>> h ON h.item_id = d.item""",
    "v_judge": f"""
        SELECT d.doc_id AS pos,
               CASE WHEN d.doc_id % 17 = 0 THEN '{{broken'
                    WHEN d.doc_id % 5 = 0 THEN concat('```json', chr(10), body, chr(10), '```') ELSE body END AS raw_text,
               CASE WHEN d.doc_id % 19 = 0 THEN '429 quota' END AS error
        FROM (SELECT d.doc_id,
                     concat('{{"grounding": ', 7 + coalesce(l.quality, 0) + d.doc_id % 3, CASE WHEN d.doc_id % 4 = 1 THEN '.5' ELSE '' END, ', "specificity": 5, "overall": ',
                            6 + coalesce(l.quality, 0) + d.doc_id % 3,
                            CASE WHEN d.doc_id % 7 = 0 THEN '}}' ELSE concat(', "feedback": "say more ', d.doc_id % 4, '"}}') END) AS body
              FROM <<documents>> d LEFT JOIN <<labels>> l ON l.doc_id = d.doc_id) d""",
    # ----------------------------------------------------------------- crawl
    "v_crawl_pages": f"""
        SELECT domain, pos, concat('https://', domain, '/p', pos % 150) AS url,
               CASE WHEN pos % 5 = 0 THEN 'home' WHEN pos % 5 = 1 THEN 'about' WHEN pos % 5 = 2 THEN 'team'
                    WHEN pos % 5 = 3 THEN 'blog' ELSE 'careers' END AS page_type, text
        FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'site0.com' ELSE concat('site', 1 + {_floor('doc_id', 6)}, '.com') END AS domain,
                     doc_id AS pos,
                     concat(text, CASE WHEN doc_id % 7 = 0 THEN ' Jane Diaz, Founder of Acme.'
                                       WHEN doc_id % 7 = 1 THEN ' CEO: Adam Stone. Also Ruth Levi, CEO at Box Corp.'
                                       WHEN doc_id % 7 = 2 THEN ' Hi, I’m Hugo Weber, one of the co-founders here.'
                                       WHEN doc_id % 7 = 3 THEN ' Nina Olsen is our Head of Sales'
                                       ELSE '' END) AS text
              FROM <<documents>>) p""",
    "v_site_status": """
        SELECT domain, CASE WHEN domain = 'site0.com' THEN 'ok' WHEN c % 11 = 3 THEN 'blocked' WHEN c % 11 = 4 THEN 'crawl_failed' ELSE 'ok' END AS status
        FROM (SELECT domain, count(*) + length(domain) + min(pos) AS c FROM <<v_crawl_pages>> GROUP BY domain) s""",
    "v_claims": f"""
        SELECT domain, pos, 'hooks' AS field, CASE WHEN pos % 5 = 0 THEN translate(substr(text, 3, 50), 'abcdefgh', 'ABCDEFGH') ELSE substr(text, 3, 50) END AS quote,
               CASE WHEN pos % 23 = 0 THEN '' ELSE url END AS source_url
        FROM <<v_crawl_pages>>
        UNION ALL
        SELECT p.domain, p.pos, 'pains' AS field, b.text AS quote, p.url AS source_url
        FROM (SELECT *, pos % (SELECT count(*) FROM <<benchmark>>) AS item FROM <<v_crawl_pages>>) p JOIN <<benchmark>> b ON b.item_id = p.item
        UNION ALL
        SELECT domain, pos, 'recent_events' AS field, concat('  ', replace(substr(text, 2, 30), ' ', '   '), ' ') AS quote, url AS source_url
        FROM <<v_crawl_pages>>""",
    "v_extractions": f"""
        SELECT domain, lead_pos,
               CASE WHEN lead_pos % 13 = 5 THEN substr(body, 1, 30)
                    WHEN lead_pos % 7 = 1 THEN concat('```json', chr(10), body, chr(10), '```')
                    WHEN lead_pos % 7 = 2 THEN substr(body, 2, 100000) ELSE body END AS raw_text,
               CASE WHEN lead_pos % 17 = 3 THEN '503 overloaded' END AS error,
               good, bad, url, lead_pos % 10 + CASE WHEN lead_pos % 4 = 1 THEN 0.5 ELSE 0 END AS specificity, lead_pos % 6 = 5 AS disqualified
        FROM (SELECT domain, lead_pos, good, bad, url,
                     concat('{{"company_name": "Co ', lead_pos, '", "geo": "EU", "services": ["a", "b"], "hooks": [',
                            '{{"hook": "h1", "quote": "', good, '", "source_url": "', url, '", "specificity": ', lead_pos % 10, CASE WHEN lead_pos % 4 = 1 THEN '.5' ELSE '' END, '}}, ',
                            '{{"hook": "h2", "quote": "', bad, '", "source_url": "', url, '", "specificity": 9}}], ',
                            '"pains": [{{"pain": "p1", "quote": "', good, '", "source_url": "', url, '", "confidence": 5.5}}], ',
                            '"recent_events": [{{"event": "e1", "quote": "', bad, '", "source_url": ""}}]',
                            CASE WHEN lead_pos % 6 = 5 THEN ', "disqualifiers": ["rival"]' ELSE '' END, '}}') AS body
              FROM (SELECT p.domain, p.pos AS lead_pos, p.url, {_safe("substr(p.text, 1, 40)")} AS good,
                           {_safe("substr(b.text, 5, 30)")} AS bad
                    FROM (SELECT *, pos % (SELECT count(*) FROM <<benchmark>>) AS item FROM <<v_crawl_pages>>) p
                    JOIN (SELECT domain AS fd, min(pos) AS fp FROM <<v_crawl_pages>> GROUP BY domain) f
                      ON f.fd = p.domain AND f.fp = p.pos
                    JOIN <<benchmark>> b ON b.item_id = p.item) x) y""",
    # -------------------------------------------------------------- contacts
    "v_people": f"""
        SELECT domain, k AS pos,
               concat(initcap_first, CASE WHEN k % 9 = 0 THEN ' Q.' ELSE '' END, ' ', initcap_last) AS name, title
        FROM (SELECT domain, k, {_pick(_TITLES, 'k')} AS title,
                     concat(upper(substr({_pick(_FIRST, 'k')}, 1, 1)), substr({_pick(_FIRST, 'k')}, 2, 20)) AS initcap_first,
                     concat(upper(substr({_pick(_LAST, _floor('k', 12))}, 1, 1)), substr({_pick(_LAST, _floor('k', 12))}, 2, 20),
                            {_letter('k')}, {_letter(_floor('k', 26))}) AS initcap_last
              FROM <<v_keys>>) p""",
    "v_emails": f"""
        SELECT domain, email, min(k) AS pos
        FROM (SELECT k, domain,
                     concat(CASE WHEN k % 11 = 0 THEN 'info' WHEN k % 11 = 1 THEN 'sales.team' WHEN k % 11 = 2 THEN 'jobs'
                                 WHEN k % 11 = 3 THEN 'support' WHEN k % 11 = 4 THEN concat(f, '.', l)
                                 WHEN k % 11 = 5 THEN concat(substr(f, 1, 1), l) WHEN k % 11 = 6 THEN f
                                 WHEN k % 11 = 7 THEN concat(l, '_', f) WHEN k % 11 = 8 THEN concat(f, '.x.', l, '.y.z.q.w')
                                 WHEN k % 11 = 9 THEN concat(f, '.', l) ELSE 'partners' END,
                            '@', CASE WHEN k % 13 = 0 THEN 'mail.org' ELSE domain END) AS email
              FROM (SELECT k, domain, {_pick(_FIRST, 'k')} AS f,
                           concat({_pick(_LAST, _floor('k', 12))}, {_letter('k')}, {_letter(_floor('k', 26))}) AS l
                    FROM <<v_keys>>) a) e
        GROUP BY domain, email""",
    "v_people_domains": """
        SELECT domain, n FROM <<v_dns>>""",
    "v_probe": f"""
        SELECT email, min(status) AS status, min(note) AS note
        FROM (SELECT concat(CASE WHEN k % 2 = 0 THEN concat(f, '.', l) ELSE concat(substr(f, 1, 1), l) END, '@', domain) AS email,
                     CASE WHEN k % 5 = 0 THEN 'invalid' WHEN k % 5 = 1 THEN 'unverified' ELSE 'valid' END AS status,
                     concat('code ', 250 + k % 5) AS note
              FROM (SELECT k, domain, {_pick(_FIRST, 'k')} AS f,
                           concat({_pick(_LAST, _floor('k', 12))}, {_letter('k')}, {_letter(_floor('k', 26))}) AS l
                    FROM <<v_keys>>) a) e
        GROUP BY email""",
    "v_officers": """
        SELECT concat('C', s_suppkey % 60) AS company_guess, s_suppkey AS pos,
               CASE WHEN s_suppkey % 9 = 0 THEN '  ' WHEN s_suppkey % 2 = 0 THEN concat('Officer ', s_suppkey % 5)
                    ELSE concat(' OFFICER ', s_suppkey % 5) END AS name,
               CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN 'Director' END AS position
        FROM <<supplier>>""",
    "v_contact_rows": f"""
        SELECT concat('x', k, '-labs.com') AS domain, CAST(1 AS INT) AS rank, concat('info@x', k, '.com') AS email, CAST(NULL AS STRING) AS matched_name,
               CASE WHEN k % 5 = 0 THEN 'high' WHEN k % 5 = 1 THEN 'medium' ELSE 'low' END AS confidence, k
        FROM <<v_keys>> WHERE segment <> 'MACHINERY'
        UNION ALL
        SELECT concat('x', k, '-labs.com') AS domain, CAST(2 AS INT) AS rank, concat('Jane@x', k, '.com') AS email, 'Jane Diaz' AS matched_name,
               CASE WHEN k % 3 = 0 THEN 'high' WHEN k % 3 = 1 THEN 'low' ELSE 'odd' END AS confidence, k
        FROM <<v_keys>> WHERE segment IN ('HOUSEHOLD', 'FURNITURE')""",
    "v_contact_domains": """
        SELECT concat('x', k, '-labs.com') AS domain,
               CASE WHEN segment <> 'MACHINERY' THEN 'ok' WHEN k % 2 = 0 THEN 'no_contacts_found' ELSE 'no_crawl_data' END AS status, k
        FROM <<v_keys>>""",
    "v_filled": """
        SELECT k AS pos, CASE WHEN k % 9 = 0 THEN 'gone.com' ELSE concat(' x', k - k % 2, '-labs.com ') END AS domain,
               CASE WHEN k % 5 = 0 THEN ' ' WHEN k % 5 = 1 THEN concat('info@x', k - k % 2, '.com') ELSE concat('new', k % 3, '@x', k - k % 2, '.com') END AS found_email,
               CASE WHEN k % 2 = 0 THEN 'Jane Diaz' ELSE '' END AS found_name, 'Founder' AS found_title,
               CASE WHEN k % 3 = 0 THEN 'y' WHEN k % 3 = 1 THEN ' Y' ELSE 'n' END AS verified_yn,
               concat('note ', k) AS notes
        FROM <<v_keys>>""",
    "v_draft_answers": f"""
        SELECT domain, attempt, lead_pos,
               CASE WHEN lead_pos % 11 = 0 AND attempt = 1 THEN 'no json at all'
                    WHEN lead_pos % 6 = 1 THEN concat('```json', chr(10), body, chr(10), '```')
                    WHEN lead_pos % 6 = 2 THEN substr(body, 2, 100000) ELSE body END AS raw_text
        FROM (SELECT domain, attempt, lead_pos,
                     concat('[{{"step": 1, "subject": "idea ', lead_pos % 4, '", "body": "',
                            CASE WHEN lead_pos % 3 = 0 AND attempt = 1 THEN 'See www.x.io and synergy' WHEN lead_pos % 10 = 7 THEN 'See www.y.io'
                                 ELSE 'Short note' END,
                            ' a', attempt, '"}}, {{"step": 2, "subject": "idea", "body": "more at https://x.io"}}, ',
                            '{{"step": 3, "subject": "idea", "body": "proof"}}, {{"step": 4, "subject": "idea", "body": "bye"}}]') AS body
              FROM (SELECT concat('x', k, '-labs.com') AS domain, 1 AS attempt, k AS lead_pos FROM <<v_keys>>
                    UNION ALL
                    SELECT concat('x', k, '-labs.com') AS domain, 2 AS attempt, k AS lead_pos FROM <<v_keys>>) a) b""",
    "v_offer": """
        SELECT 'Nimbus' AS your_company_name, min(n_name) AS sender_name, 'capacity planning' AS what_you_sell,
               'mid-size shops' AS icp_description, 'soft ask' AS cta_style, CAST(count(*) AS INT) AS nations
        FROM <<nation>>""",
    # ------------------------------------------------------------ site pages
    "v_site": """
        SELECT page_id, url, html, host, CASE WHEN page_id = first_id THEN 'home'
                    WHEN page_id % 6 = 0 THEN 'blog' WHEN page_id % 6 = 1 THEN 'about' WHEN page_id % 6 = 2 THEN 'team'
                    WHEN page_id % 6 = 3 THEN 'contact' WHEN page_id % 6 = 4 THEN 'careers' ELSE 'services' END AS page_type
        FROM (SELECT page_id, url, html, split_part(split_part(url, '/', 3), '?', 1) AS host FROM <<pages>>) p
        JOIN (SELECT split_part(split_part(url, '/', 3), '?', 1) AS fh, min(page_id) AS first_id FROM <<pages>> GROUP BY 1) f
          ON f.fh = p.host""",
    "v_site_pages": f"""
        SELECT host AS domain, page_id AS pos, page_type,
               CASE WHEN page_id % 13 = 12 THEN concat('https://', host, '/files/d', page_id, '.PDF') ELSE url END AS url,
               CASE WHEN page_id % 13 = 12 THEN concat('Plain text of file ', page_id, ', write to desk', page_id, '@', host, ' or a@test.com')
                    ELSE replace(replace(html, '</article>', concat(extra, '</article>')), '<body>',
                         CASE WHEN page_id % 19 = 5 THEN '<body><p>Checking your browser before access</p>' ELSE '<body>' END) END AS html
        FROM (SELECT page_id, url, html, host, page_type,
                     concat('<!-- <a href="/team">Team</a> ghost@', host, ' --><div class="card"><h3><button>', person, '</button></h3><div><p>', title, '</p></div></div>',
                            '<h3>Get Started</h3><p>Manager</p><h4>', person, '</h4><p>', title, '</p>',
                            '<a href="mailto:Desk', page_id % 4, '@', host, '?subject=hi">mail us</a> <a href="mailto:bad address">x</a>',
                            ' sales@', host, ' icon', page_id, '@2x.png noreply@sentry.io ops&#64;', host, ' bob@test-lab.com',
                            CASE WHEN page_id % 4 = 0 THEN ' x@mail5.example.com' ELSE '' END,
                            '<a href="/about-us?cta=', page_id, '">About Us</a><a href="team/">Meet <b>the</b> team</a>',
                            '<a href="../contact#x">Contact</a><a href="https://other.org/blog">Blog</a>',
                            '<a href="//', host, '/news/1">News</a><a href="https://', host, '/random">we wrote about our team and services here</a>',
                            '<a href="https://', host, '/x/y?a=1">Jobs</a><a href="/blog/two">two</a><a href="/insights/">three</a>',
                            '<table><tr><td>cell one</td><td>cell two</td></tr></table>',
                            '<p>caf&eacute; &euro;5 &#38;lt;b &amp;lt; &NotEqualTilde; &notit; &copy2024 &#x80; &#0; &#1114112; &bogus; AT&T &;</p>',
                            CASE WHEN page_id % 3 = 0 THEN concat('<script type="application/ld+json">{{"@type":"Organization","employees":[{{"@type":"Person","name":"', person, ' Ld","jobTitle":"CTO"}},{{"@type":"Thing","name":"No"}}],"founder":{{"@type":"Person","name":" Ann Solo "}}}}</script>')
                                 WHEN page_id % 3 = 1 THEN '<script type="application/ld+json">{{"@graph":[{{"member":{{"@type":"Person","name":"Gil Graph"}}}}]}}</script>'
                                 ELSE '<script type="application/ld+json">{{broken</script>' END) AS extra
              FROM (SELECT page_id, url, html, host, page_type, {_pick(_TITLES, 'page_id')} AS title,
                           concat(upper(substr({_pick(_FIRST, 'page_id')}, 1, 1)), substr({_pick(_FIRST, 'page_id')}, 2, 20), ' ',
                                  upper(substr({_pick(_LAST, 'page_id')}, 1, 1)), substr({_pick(_LAST, 'page_id')}, 2, 20)) AS person
                    FROM <<v_site>>) s) t""",
    "v_store": """
        SELECT p.domain, p.pos, CASE WHEN p.page_type = 'home' THEN 'home' END AS page_type,
               CASE WHEN p.page_type = 'home' THEN p.url
                    ELSE concat(split_part(p.url, ':', 1), '://', p.domain,
                                CASE p.pos % 9 WHEN 0 THEN '/about-us' WHEN 1 THEN '/contact' WHEN 2 THEN '/news/1' WHEN 3 THEN '/x/y' WHEN 4 THEN '/about/1'
                                     WHEN 5 THEN '/our-team/news0' WHEN 6 THEN '/blog/2' WHEN 7 THEN '/about_us' ELSE concat('/files/d', p.pos, '.pdf') END) END AS url,
               CASE WHEN p.pos % 23 <> 4 THEN p.html END AS html,
               CASE WHEN p.pos % 23 = 4 THEN 'timeout' END AS fetch_error,
               CAST(p.pos % 40 AS DOUBLE) / 4 AS fetch_sec
        FROM <<v_site_pages>> p
        WHERE p.page_type <> 'home' OR length(p.domain) % 7 <> 3""",
    "v_wanted": """
        SELECT host AS domain FROM <<v_site>>
        UNION ALL SELECT concat('gone', page_id % 50, '.com') AS domain FROM <<v_site>>""",
    "v_robots": """
        SELECT host AS domain, '*' AS agent, 1 AS pos, true AS allow, '/en/1' AS path FROM <<v_site>> WHERE page_type = 'home'
        UNION ALL
        SELECT host AS domain, '*' AS agent, 2 AS pos, false AS allow, CASE WHEN page_id % 7 = 0 THEN '/' WHEN page_id % 2 = 0 THEN '/en' ELSE '/fr/' END AS path
        FROM <<v_site>> WHERE page_type = 'home'
        UNION ALL
        SELECT host AS domain, 'LeadBot' AS agent, 1 AS pos, false AS allow, CASE WHEN page_id % 3 = 0 THEN '' ELSE '/de' END AS path
        FROM <<v_site>> WHERE page_type = 'home' AND url LIKE 'http:%'""",
    "v_sitemap": """
        SELECT s.host AS domain, 1 + s.page_id - f.low AS pos,
               CASE WHEN s.page_id % 7 = 0 THEN concat(' /about/', s.page_id % 3, ' ') WHEN s.page_id % 7 = 1 THEN concat('https://', s.host, '/blog/', s.page_id % 5)
                    WHEN s.page_id % 7 = 2 THEN concat('/our-team/news', s.page_id % 2) WHEN s.page_id % 7 = 3 THEN '/about_us'
                    WHEN s.page_id % 7 = 4 THEN concat('/pricing?p=', s.page_id % 2) WHEN s.page_id % 7 = 5 THEN '/about/1' ELSE s.url END AS loc
        FROM <<v_site>> s JOIN (SELECT host AS fh, min(page_id) AS low FROM <<v_site>> GROUP BY host) f ON f.fh = s.host""",
}
