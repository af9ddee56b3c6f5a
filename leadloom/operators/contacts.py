"""Addresses matched to people, patterns learnt, contacts ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.functions import addresses as A
from leadloom.functions import urls
from leadloom.functions.text import first_of, text_array
from leadloom.operators.ordering import first_k, keep_first
from leadloom.schemas import CONTACTS
from leadloom.session import settle

# Local parts with up to this many words list all their word sets as join
# keys; longer ones go through one key per word and a containment test.
MAX_LISTED_TOKENS = 5


def word_sets(tokens: Column) -> Column:
    """Every non-empty subset of a sorted word array, as joined text."""
    none = F.array(F.array().cast("array<string>"))
    subsets = F.aggregate(
        tokens, none, lambda acc, t: F.concat(acc, F.transform(acc, lambda s: F.array_append(s, t)))
    )
    return F.filter(F.transform(subsets, lambda s: F.array_join(s, " ")), lambda k: k != "")


def match_people(emails: DataFrame, people: DataFrame) -> DataFrame:
    """Each address with the first person it names, or NULLs.

    An address names a person when all words of the name are among the words
    of its local part, or when the local part is the first word of the name.
    emails: domain, pos, email; people: domain, pos, name, title (pos sorts).

    Both tests are equi-joins: a person is keyed by the set of name words and
    by the first word, an address by every set its words can form.  People
    with equal keys are reduced to the first before the join, so no pair that
    is not a match is ever built, whatever the size of a domain.
    """
    person = F.struct(F.col("pos").alias("pos"), "name", "title")
    first_word = F.lower(F.get(F.split(F.trim("name"), r"(?U)\s+"), F.lit(0)))
    keys = F.array(
        F.concat(F.lit("set "), F.array_join(A.name_tokens("name"), " ")), F.concat(F.lit("first "), first_word)
    )
    keyed_people = (
        people.select("domain", person.alias("person"), F.explode(keys).alias("key"))
        .groupBy(F.col("domain").alias("__pd"), F.col("key").alias("__key"))
        .agg(F.min("person").alias("person"))
    )
    tokens = A.local_tokens("email")
    plain = F.lower(F.regexp_replace(A.local_part("email"), "[._]", " "))
    short = F.size("__tokens") <= MAX_LISTED_TOKENS
    sets = F.transform(word_sets(F.when(short, F.col("__tokens"))), lambda k: F.concat(F.lit("set "), k))
    lookup = F.array_append(F.coalesce(sets, text_array([])), F.concat(F.lit("first "), plain))
    addressed = emails.withColumn("__tokens", tokens)
    listed = (
        addressed.select("domain", "email", F.explode(lookup).alias("__k"))
        .join(keyed_people, (F.col("domain") == F.col("__pd")) & (F.col("__k") == F.col("__key")))
        .select("domain", "email", "person")
    )
    # Names hold few words, so their first sorted word is one of the address's.
    by_word = people.groupBy(F.col("domain").alias("__pd"), A.name_tokens("name").alias("__words")).agg(
        F.min(person).alias("person")
    )
    long = (
        addressed.where(~short)
        .select("domain", "email", "__tokens", F.explode("__tokens").alias("__w"))
        .join(by_word, (F.col("domain") == F.col("__pd")) & (F.col("__w") == F.get("__words", F.lit(0))))
        .where(F.size(F.array_except("__words", "__tokens")) == 0)
        .select("domain", "email", "person")
    )
    matched = (
        listed.unionByName(long)
        .groupBy(F.col("domain").alias("__md"), F.col("email").alias("__me"))
        .agg(F.min("person").alias("person"))
    )
    return (
        emails.join(matched, (F.col("domain") == F.col("__md")) & (F.col("email") == F.col("__me")), "left")
        .select(emails["*"], F.col("person.name").alias("matched_name"), F.col("person.title").alias("matched_title"))
    )


def template_votes(matched: DataFrame, templates=None) -> DataFrame:
    """Votes per domain and template: (domain, template, votes, first_pos)."""
    place = A.template_of(F.col("matched_name"), F.col("email"), templates)
    return (
        matched.where(F.col("matched_name").isNotNull())
        .withColumn("template", place)
        .where(F.col("template") > 0)
        .groupBy("domain", "template")
        .agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first_pos"))
    )


def domain_templates(votes: DataFrame) -> DataFrame:
    """The template with most votes; the first to get one wins a tie."""
    best = F.max(F.struct("votes", (-F.col("first_pos")).alias("early"), "template"))
    return votes.groupBy("domain").agg(best.alias("b")).select("domain", F.col("b.template").alias("template"))


def _candidate(source: str, role: Column, priority: Column, name: Column, title: Column) -> list[Column]:
    return [
        F.col("domain"), F.col("email"), role.alias("role"), priority.cast("int").alias("priority"),
        name.alias("matched_name"), title.alias("matched_title"), F.lit(source).alias("source"),
    ]


def scraped_candidates(matched: DataFrame) -> DataFrame:
    role = A.role_of("email")
    bonus = F.when(F.col("matched_name").isNotNull(), 1).otherwise(0)
    return matched.select(
        *_candidate("scraped", role["role"], role["priority"] - bonus, F.col("matched_name"), F.col("matched_title"))
    )


def unresolved_people(people: DataFrame, matched: DataFrame) -> DataFrame:
    """People whose name no address was matched to."""
    resolved = matched.where(F.col("matched_name").isNotNull()).select(
        F.col("domain").alias("__d"), F.lower("matched_name").alias("__n")
    ).distinct()
    return people.join(resolved, (F.col("domain") == F.col("__d")) & (F.lower("name") == F.col("__n")), "left_anti")


def derive_addresses(people: DataFrame, matched: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(derived candidates, pending people).

    Where the domain's template is known, a person with usable name parts
    gets an address, unless it exists already, in which case the person is
    dropped.  Everyone else is pending.
    """
    open_people = unresolved_people(people, matched).join(
        templates.select(F.col("domain").alias("__td"), "template"), F.col("domain") == F.col("__td"), "left"
    )
    local = F.when(F.col("template").isNotNull(), A.fill_by_place(F.col("template"), F.col("name")))
    tried = open_people.withColumn("__local", local)
    pending = tried.where(F.col("__local").isNull()).select("domain", "pos", "name", "title")
    derived = tried.where(F.col("__local").isNotNull()).withColumn(
        "email", F.concat("__local", F.lit("@"), "domain")
    )
    known = matched.select(F.col("domain").alias("__kd"), F.col("email").alias("__ke")).distinct()
    fresh = derived.join(known, (F.col("domain") == F.col("__kd")) & (F.col("email") == F.col("__ke")), "left_anti")
    first = keep_first(fresh, ["domain", "email"], [F.col("pos")])
    role = A.role_of("email")
    candidates = first.select(
        *_candidate("pattern_derived", role["role"], role["priority"] - 1, F.col("name"), F.col("title"))
    )
    return candidates, pending


def guessed_candidates(domains: DataFrame, emails: DataFrame, prefixes=None) -> DataFrame:
    """Common addresses for domains that published none."""
    having = emails.select(F.col("domain").alias("__d")).distinct()
    bare = domains.select("domain").join(having, F.col("domain") == F.col("__d"), "left_anti")
    named = bare.select("domain", F.explode(text_array(prefixes or fixed.GUESS_PREFIXES)).alias("__p")).withColumn(
        "email", F.concat("__p", F.lit("@"), "domain")
    )
    role, nobody = A.role_of("email"), F.lit(None).cast("string")
    return named.select(*_candidate("guessed", role["role"], role["priority"] + 3, nobody, nobody))


def build_candidates(domains: DataFrame, emails: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, pending people) of every domain.

    Four steps read the matches, so they are written once.
    """
    matched = settle(match_people(emails, people), "matched")
    templates = domain_templates(template_votes(matched))
    derived, pending = derive_addresses(people, matched, templates)
    found = scraped_candidates(matched).unionByName(derived).unionByName(guessed_candidates(domains, emails))
    return found, pending


def top_pending(pending: DataFrame, limit: int = fixed.MAX_PENDING_PEOPLE) -> DataFrame:
    """Most senior decision-makers per domain; ties keep their order."""
    deciders = pending.where(A.is_decision_maker("title")).withColumn("seniority", A.seniority("title"))
    return first_k(deciders, ["domain"], [F.col("seniority"), F.col("pos")], limit)


def domain_facts(dns_facts: DataFrame, catch_all_facts: DataFrame) -> DataFrame:
    """(domain, has_mx, catch_all), one row per domain with a fact."""
    mx = dns_facts.select("domain", F.coalesce(F.size("mx") > 0, F.lit(False)).alias("has_mx"))
    catch = catch_all_facts.select(F.col("domain").alias("__c"), "catch_all")
    return mx.join(catch, F.col("domain") == F.col("__c"), "left").select(
        "domain", "has_mx", F.coalesce("catch_all", F.lit(False)).alias("catch_all")
    )


def resolve_pending(pending: DataFrame, facts: DataFrame, probe_facts: DataFrame, verify: bool,
                    max_templates: int = fixed.MAX_PROBED_TEMPLATES) -> DataFrame:
    """One candidate per pending decision-maker, at most.

    Where mailboxes can be verified, the first template whose probe fact is
    valid; otherwise one address of the commonest template, marked a guess.
    """
    chosen = top_pending(pending).join(
        facts.select(F.col("domain").alias("__fd"), "has_mx", "catch_all"), F.col("domain") == F.col("__fd"), "left"
    ).fillna(False, ["has_mx", "catch_all"])
    if not verify:
        chosen = chosen.withColumn("catch_all", F.lit(False))
    verifiable = F.lit(verify) & F.col("has_mx") & ~F.col("catch_all")
    tried = fixed.ADDRESS_TEMPLATES[:max_templates]
    valid = probe_facts.where(F.col("status") == "valid").select(
        F.col("email").alias("__pe"), F.coalesce("note", F.lit("")).alias("__note")
    )
    person = F.struct("pos", "name", "title")
    probed = (
        chosen.where(verifiable)
        .select("domain", person.alias("person"), F.posexplode(A.template_locals("name", tried)).alias("place", "__local"))
        .where(F.col("__local").isNotNull())
        .withColumn("email", F.concat("__local", F.lit("@"), "domain"))
        .join(valid, F.col("email") == F.col("__pe"))
        .groupBy("domain", "person")
        .agg(F.min(F.struct("place", "email", "__note")).alias("hit"))
        .select(
            "domain", F.col("hit.email").alias("email"), "person", F.lit("pattern_bruteforce_verified").alias("source"),
            F.lit("valid").alias("verification"), F.col("hit.__note").alias("verification_note"), F.lit(0).alias("priority"),
        )
    )
    note = first_of(
        [
            (F.col("catch_all"), F.lit(fixed.NOTE_GUESS_CATCH_ALL)),
            (~F.col("has_mx"), F.lit(fixed.NOTE_GUESS_NO_MX)),
        ],
        F.lit(fixed.NOTE_GUESS_SPECULATIVE),
    )
    guessed = (
        chosen.where(~verifiable)
        .withColumn("__local", A.fill_template(fixed.ADDRESS_TEMPLATES[0], "name"))
        .where(F.col("__local").isNotNull())
        .select(
            "domain", F.concat("__local", F.lit("@"), "domain").alias("email"), person.alias("person"),
            F.lit("pattern_guessed").alias("source"),
            F.when(F.col("catch_all"), "catch_all").otherwise("unverified").alias("verification"),
            note.alias("verification_note"), F.lit(3).alias("priority"),
        )
    )
    return probed.unionByName(guessed).select(
        "domain", "email", A.role_of("email")["role"].alias("role"), "priority",
        F.col("person.name").alias("matched_name"), F.col("person.title").alias("matched_title"), "source",
        "verification", "verification_note",
    )


def verify_candidates(candidates: DataFrame, facts: DataFrame, probe_facts: DataFrame, verify: bool) -> DataFrame:
    """Add verification and note from the facts on each address's own domain.

    A preset outcome stays.  Fact tables have one row per key; AQE splits the
    address side when a mail provider's domain dominates it.
    """
    own = A.address_domain("email")
    if "verification" not in candidates.columns:
        candidates = candidates.withColumn("verification", F.lit(None).cast("string")).withColumn(
            "verification_note", F.lit(None).cast("string")
        )
    joined = candidates.withColumn("__own", own).join(
        facts.select(F.col("domain").alias("__fd"), "has_mx", "catch_all"), F.col("__own") == F.col("__fd"), "left"
    )
    status, note = F.lit("not_checked"), F.lit(fixed.NOTE_NOT_CHECKED)
    if verify:
        probes = probe_facts.select(F.col("email").alias("__pe"), F.col("status").alias("__ps"), F.col("note").alias("__pn"))
        joined = joined.join(probes, F.col("email") == F.col("__pe"), "left")
        catch = F.coalesce(F.col("catch_all"), F.lit(False))
        status = F.when(catch, "catch_all").otherwise(F.coalesce(F.col("__ps"), F.lit("unverified")))
        note = F.when(catch, fixed.NOTE_CATCH_ALL).otherwise(F.coalesce(F.col("__pn"), F.lit("")))
    preset, dead = F.col("verification").isNotNull(), ~F.coalesce(F.col("has_mx"), F.lit(False))
    return joined.select(
        *[F.col(c) for c in candidates.columns if c not in ("verification", "verification_note")],
        first_of([(preset, F.col("verification")), (dead, F.lit("unverified"))], status).alias("verification"),
        first_of([(preset, F.col("verification_note")), (dead, F.lit(fixed.NOTE_NO_MX))], note).alias("verification_note"),
    )


def rank_contacts(verified: DataFrame, limit: int = fixed.MAX_CONTACTS_PER_DOMAIN) -> DataFrame:
    """Best contacts per domain; invalid addresses never count."""
    guess = F.col("source").isin("guessed", "pattern_guessed")
    usable = verified.where(F.col("verification") != "invalid")
    order = [F.col("priority"), guess, F.col("email"), F.coalesce("matched_name", F.lit(""))]
    top = first_k(usable, ["domain"], order, limit, "rank")
    named = F.col("matched_name").isNotNull()
    return top.select(
        "domain", "rank", "email", "role", "matched_name", "matched_title", "source", "verification",
        "verification_note",
        A.confidence(F.col("source"), F.col("matched_name"), F.col("verification")).alias("confidence"),
        F.when(named, urls.person_search_url("matched_name", "domain")).alias("linkedin_lookup_url"),
    )


CONTACT_FIELDS = CONTACTS.elementType.names


def contacts_results(crawled: DataFrame, ranked: DataFrame, as_of: Column, verify: bool) -> DataFrame:
    """One row per crawled domain.  Lists hold at most the contact limit."""
    usable = crawled.where(F.col("status") == "ok").select(F.col("domain").alias("__ok"))
    entry = F.struct("rank", *CONTACT_FIELDS)
    lists = (
        ranked.join(usable, F.col("domain") == F.col("__ok"), "left_semi")
        .groupBy(F.col("domain").alias("__d"))
        .agg(F.array_sort(F.collect_list(entry)).alias("__list"))
    )
    plain = F.transform("__list", lambda c: F.struct(*[c[n].alias(n) for n in CONTACT_FIELDS]))
    return crawled.select("domain", F.col("status").alias("__crawl")).join(
        lists, F.col("domain") == F.col("__d"), "left"
    ).select(
        "domain",
        as_of.alias("processed_at"),
        first_of(
            [
                (F.coalesce("__crawl", F.lit("")) != "ok", F.lit("no_crawl_data")),
                (F.coalesce(F.size("__list"), F.lit(0)) > 0, F.lit("ok")),
            ],
            F.lit("no_contacts_found"),
        ).alias("status"),
        F.coalesce(plain, F.array().cast(CONTACTS)).alias("contacts"),
        F.lit(verify).alias("smtp_probing_enabled"),
    )


def contacts_summary(results: DataFrame) -> DataFrame:
    """One line per domain with its best contact."""
    best = F.get("contacts", F.lit(0))

    def field(name: str) -> Column:
        return F.coalesce(best[name], F.lit(""))

    return results.select(
        "domain", "status", F.size("contacts").alias("contacts_found"), field("email").alias("best_email"),
        field("confidence").alias("best_confidence"), field("verification").alias("best_verification"),
    )


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("domains"))


def best_contact(contacts: Column) -> Column:
    """Highest confidence; the earlier entry wins a tie."""
    ranked = F.transform(
        contacts, lambda c, i: F.struct(A.confidence_rank(c["confidence"]).alias("rank"), i.alias("i"), c.alias("c"))
    )
    return F.array_min(ranked)["c"]


# --------------------------------------------------------------------------
# Gaps to be filled by hand
# --------------------------------------------------------------------------
def gap_reason(status: Column, contacts: Column) -> Column:
    all_low = (F.size(contacts) > 0) & F.forall(contacts, lambda c: F.coalesce(c["confidence"] == "low", F.lit(False)))
    return first_of(
        [
            (status.isin("no_contacts_found", "no_crawl_data"), F.lit("no_contact")),
            (F.coalesce(all_low, F.lit(False)), F.lit("low_confidence")),
        ],
        F.lit(None).cast("string"),
    )


def gap_rows(results: DataFrame) -> DataFrame:
    """Domains without a usable contact, with blank columns to fill in."""
    reason = gap_reason(F.col("status"), F.col("contacts"))
    company = urls.company_display("domain")
    best = F.get("contacts", F.lit(0))
    blank = [F.lit("").alias(c) for c in ("found_name", "found_title", "found_email", "verified_yn", "notes")]
    quoted = F.concat(F.lit('"'), company, F.lit('"'))
    return results.withColumn("gap_reason", reason).where(F.col("gap_reason").isNotNull()).select(
        "domain",
        company.alias("company_name_guess"),
        "gap_reason",
        F.coalesce(best["matched_name"], F.lit("")).alias("existing_best_name"),
        F.coalesce(best["email"], F.lit("")).alias("existing_best_email"),
        urls.web_search_url(F.concat(quoted, F.lit(' founder OR CEO OR "head of sales"'))).alias("google_search_url"),
        urls.web_search_url(F.concat(quoted, F.lit(" "), F.col("domain"), F.lit(" site:linkedin.com/in"))).alias(
            "linkedin_search_url"
        ),
        *blank,
    )


def filled_gaps(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Filled rows with `outcome`: imported, skipped_blank, skipped_no_domain_dir."""
    known = results.select(F.col("domain").alias("__k"))
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    clean = rows.select(
        "pos", text("domain").alias("domain"), text("found_email").alias("email"),
        F.nullif(text("found_name"), F.lit("")).alias("matched_name"),
        F.nullif(text("found_title"), F.lit("")).alias("matched_title"),
        (F.upper(text("verified_yn")) == "Y").alias("verified"),
        F.coalesce("notes", F.lit("")).alias("notes"),
    )
    return clean.join(known, F.col("domain") == F.col("__k"), "left").withColumn(
        "outcome",
        first_of(
            [(F.col("email") == "", F.lit("skipped_blank")), (F.col("__k").isNull(), F.lit("skipped_no_domain_dir"))],
            F.lit("imported"),
        ),
    ).drop("__k")


def import_gaps(results: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Results with hand-found contacts appended, unless the very address is
    there already; a domain with any import becomes ok.

    New addresses are made distinct per domain before they are gathered.
    """
    nothing = F.lit(None).cast("string")
    entry = F.struct(
        F.col("email"), F.lit("other").alias("role"), F.col("matched_name"), F.col("matched_title"),
        F.lit("manual_lookup").alias("source"),
        F.when(F.col("verified"), "human_verified").otherwise("human_found_unverified").alias("verification"),
        F.col("notes").alias("verification_note"),
        F.when(F.col("verified"), "high").otherwise("medium").alias("confidence"),
        nothing.alias("linkedin_lookup_url"),
    )
    imported = outcomes.where(F.col("outcome") == "imported")
    first = keep_first(imported, ["domain", "email"], [F.col("pos")])
    lists = first.groupBy(F.col("domain").alias("__d")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", entry.alias("c")))), lambda e: e["c"]).alias("__new")
    )
    joined = results.join(lists, F.col("domain") == F.col("__d"), "left")
    present = F.transform("contacts", lambda c: c["email"])
    added = F.filter("__new", lambda c: ~F.array_contains(present, c["email"]))
    merged = F.when(F.col("__new").isNull(), F.col("contacts")).otherwise(F.concat("contacts", added))
    return joined.withColumn("__merged", merged).select(
        *[
            first_of([(F.col("__new").isNotNull(), F.lit("ok"))], F.col("status")).alias("status") if c == "status"
            else F.col("__merged").alias("contacts") if c == "contacts"
            else F.col(c)
            for c in results.columns
        ]
    )


def import_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("imported", "skipped_blank", "skipped_no_domain_dir")]
    )
