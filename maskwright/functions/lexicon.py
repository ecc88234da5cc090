"""Word tables.  Fixed values: they decide what is a name, so results depend on every entry."""

from __future__ import annotations

#: Words that mean one legal form, a line each.
LEGAL_FORMS: tuple[tuple[str, ...], ...] = tuple(
    tuple(w.strip() for w in line.split(","))
    for line in """
    ltd, ltd., limited, co ltd, co. ltd, co.ltd
    llc, l.l.c., l.l.c, lc
    inc, inc., incorporated
    corp, corp., corporation
    plc, p.l.c.
    gmbh
    ug
    ag
    kg
    se
    gbr
    ohg
    kgaa
    partg, partgmbb
    llp, l.l.p.
    lp, l.p.
    bv, b.v., b v
    nv, n.v.
    sa, s.a.
    sl, s.l.
    srl, s.r.l.
    spa, s.p.a.
    dmcc
    fzco
    fze
    pjsc
    jsc
    pte
    oy
    ab
    as, a/s
    doo, d.o.o., d.o.o
    ad
    sirketi
    anonim
    ооо
    оао
    зао
    пао
    ао
    """.strip().splitlines()
)
HONORIFICS = frozenset("herr herrn frau fräulein dr prof professor mr mrs ms miss mme mlle sr sra sig sig.ra sir dame lord lady hon господин госпожа г-н г-жа".split())
JOINERS = frozenset("of and the und von van der den de du la le y".split())
PATRONYMIC_TAILS = "ович евич ьич овна евна ична инична ovich evich yevich ayevich ovna evna ichna".split()
STRUCTURE = frozenset(
    """centre center tower building house street road avenue plaza square floor district region city port airport hotel island
    county province bay harbour harbor station park bridge
    улица дом здание центр башня площадь район город порт область край проспект набережная остров
    straße strasse str weg platz allee ufer damm ring gasse chaussee wohnung etage stock og eg haus gebäude stadt""".split()
)
ROLE_STEMS = tuple(
    x.strip()
    for x in """истец, истц, ответчик, ответчиц, заявител, заинтересован, третье лицо, должник, взыскател, потерпевш, свидетел,
    представител, доверител, claimant, respondent, plaintiff, defendant, applicant, appellant, petitioner, witness, trustee,
    liquidator, administrator, kläger, beklagt, antragstell, antragsgegn, schuldner, gläubiger, zeug, vermieter, mieter,
    geschäftsführ, gesellschaft, insolvenzverwalt, betreuer""".split(",")
)
GENERIC = frozenset(
    """client husband wife spouse company entity management shipping corporation holding group draft roadmap overview shareholding
    shareholdings director manager owner shareholder unknown n/a
    клиент муж жена супруг супруга компания общество подача уплатить предварительное давности""".split()
)
COMMON = frozenset(
    """forwarded message original subject from sent to cc bcc attachment attached reply regards best dear kind sincerely
    translated machine translation page note notes summary memo confidential privileged draft final version appendix annex
    br fyi asap re fwd ps nb table figure section article clause schedule exhibit
    container ship vessel cargo bulk carrier fleet charter trading trade trades invoice payment account bank loan
    purchase sale seller buyer lease asset assets share shares capital profit loss value price total amount balance
    registration register certificate licence license agreement contract letter notice claim court case matter law legal
    verifying keeping checking confirming pending unconfirmed yes no and or the of in on at for with without
    debts debt annual year years other taxes tax rules code cash equity reserves income expenses
    white black green blue red golden silver royal grand global international national general united new old great
    first second third north south east west central prosperity ocean sea river lake rock star sun moon sky wave
    der die das den dem des ein eine einer eines einem einen ihr ihre ihrer ihren ihrem sie wir unser unsere sehr geehrte
    geehrter mit freundlichen grüßen grüssen anlage schreiben betreff kündigung wohnung recht rechte mietvertrag mietverhältnis
    miete eigenbedarf widerspruch härte frist termin urteil beschluss antrag klage vertrag vereinbarung gesellschafterin
    gesellschafter hinweis insert title rate vat address date name placeholder tbd tbc""".split()
)
#: What a token stands for, by kind.
KIND_WORDS = {
    "PERSON": "individual (natural person)",
    "ORG": "organisation",
    "VESSEL": "vessel",
    "ACCOUNT": "bank account",
    "ID": "registration/identity number",
    "IBAN": "bank account number",
    "EMAIL": "email address",
    "PHONE": "telephone number",
    "CARD": "payment card number",
    "IP": "IP address",
    "PROPERTY": "real property",
}
RELATION_WORDS = {"shareholder": "shareholder in", "beneficial_owner": "beneficial owner of", "owns": "owns", "controls": "controls", "parent_of": "parent of", "linked": "linked to"}
FEMALE_TAILS = tuple("ova eva ina aya skaya ская ова ева ина ая".split())
MALE_TAILS = tuple("ov ev in sky skiy ski ich ский ов ев ин ий".split())
#: Kinds of seeded entities, and roles that tell an organisation from a person (in this order).
ENTITY_KINDS = {"individual": "PERSON", "company": "ORG", "vessel": "VESSEL", "account": "ACCOUNT", "property": "PROPERTY"}
ORG_ROLES = tuple(
    x.strip()
    for x in """company, entity, corporation, corp, holding, vessel owner, shipowner, ship owner, lessor, lessee, bank, employer, firm, llc,
    ltd, limited, insurer, charterer, operator, registry, counterparty / company, subsidiary""".split(",")
)
PERSON_ROLES = tuple(
    x.strip()
    for x in """individual, person, director, shareholder, beneficial owner, manager, subject, applicant, respondent, claimant, spouse,
    husband, wife, client, employee, accountant, witness, officer, signatory, heir, son, daughter""".split(",")
)
