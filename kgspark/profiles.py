"""Closed vocabularies as data: one profile per domain, small enough to become literals in a plan."""

from __future__ import annotations

from dataclasses import dataclass, field

DIMENSIONS = ("structural", "causal", "relational", "temporal", "intentional")
DEFAULT_DIMENSION = "relational"
QUANTIFICATIONS = frozenset(("universal", "existential", "definite", "count(n)", "null"))
#: Identifier schemes of sources, tried in order; group 1 is the identifier.
SCHEMES = {
    "celex": r"(?i)celex[\s:_-]*([0-9]{5}[a-z]{1,2}[0-9]{3,4}(?:_(?:sum|inf))?)",
    "doi": r"(?i)\b(10\.\d{4,9}/[-._;()/:a-z0-9]+)\b",
    "arxiv": r"\b(\d{4}\.\d{4,5})(?:v\d+)?\b",
}


@dataclass(frozen=True)
class Marker:
    ord: int
    pattern: str
    predicate: str
    modality: str


@dataclass(frozen=True)
class Profile:
    id: str
    namespace: str
    version: str
    markers: tuple[Marker, ...]
    dimensions: dict[str, str]
    predicates: frozenset[str]
    modalities: frozenset[str]
    normative: frozenset[str]
    cues: tuple[tuple[str, tuple[str, ...]], ...]
    verbs: frozenset[str]
    schemes: tuple[str, ...]
    principles: frozenset[str] = frozenset()
    canons: frozenset[str] = frozenset()
    rules: frozenset[str] = frozenset()
    ranks: dict[str, int | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        strange = set(self.dimensions) - self.predicates | {d for d in self.dimensions.values() if d not in DIMENSIONS}
        if strange:
            raise ValueError(f"dimensions of {self.id} name what it doesn't have: {sorted(strange)}")

    def dimension_for(self, predicate: str) -> str:
        return self.dimensions.get(predicate, DEFAULT_DIMENSION)

    def unmapped_predicates(self) -> list[str]:
        return sorted(self.predicates - set(self.dimensions))

    def federation_projections(self) -> list[dict[str, str]]:
        return [{"profile": self.id, "predicate": p, "dimension": self.dimension_for(p), "mapped": str(p in self.dimensions).lower()} for p in sorted(self.predicates)]

    def axis(self, name: str) -> frozenset[str]:
        """Members of a closed axis; an unknown axis is an error."""
        axes = {
            "predicate": self.predicates, "modality": self.modalities, "quantification": QUANTIFICATIONS, "principle": self.principles,
            "judicial_canon": self.canons, "inference_rule": self.rules, "polarity": frozenset("DN"), "dimension": frozenset(DIMENSIONS),
        }
        return axes[name]

    def is_valid(self, axis: str, value: str) -> bool:
        return value in self.axis(axis)


def _groups(text: str) -> dict[str, list[str]]:
    return {k: v.split() for k, _, v in (part.partition(": ") for part in text.split("; ") if part)}


def _profile(name: str, namespace: str, version: str, *, markers: str, dimensions: str, predicates: str, modalities: str, normative: str, cues: str, verbs: str, schemes: str, principles: str = "", canons: str = "null", rules: str = "", ranks: str = "") -> Profile:
    found = []
    for line in filter(None, map(str.strip, markers.splitlines())):
        kind, _, patterns = line.partition(" = ")
        predicate, _, modality = kind.partition("/")
        found += [Marker(len(found) + k, p, predicate, modality) for k, p in enumerate(patterns.split(" | "))]
    return Profile(
        name, namespace, version, tuple(found),
        {p: d for d, ps in _groups(dimensions).items() for p in ps},
        frozenset(predicates.split()), frozenset(modalities.split()), frozenset(normative.split()),
        tuple((v, tuple(c.split("|"))) for v, _, c in (part.partition(": ") for part in cues.split("; ") if part)),
        frozenset(filter(None, verbs.split("|"))), tuple(schemes.split()),
        frozenset(f"principle:{p}" for p in principles.split()), frozenset(canons.split()), frozenset(rules.split()),
        {k: None if r == "None" else int(r) for r, ks in _groups(ranks).items() for k in ks},
    )


BUILT_IN = (
    _profile(
        "generic", "kg", "generic-v0",
        markers="""
        defines/definitional = is defined as
        causes/asserted = causes
        defines/definitional = means
        """,
        dimensions="causal: causes enables prevents; relational: asserts refutes relates supports; structural: defines",
        predicates="asserts causes defines enables prevents refutes relates supports",
        modalities="asserted definitional hypothesized null",
        normative="",
        cues="universal: each|every|all |any ; existential: at least one|at least",
        verbs="is defined as|means",
        schemes="doi arxiv",
        principles="",
        canons="null",
        rules="abduction analogy induction modus_ponens unspecified",
        ranks="",
    ),
    _profile(
        "law-eu", "dls", "nd-eu-law-v1",
        markers="""
        imposes/obliged = shall ensure
        prohibits/prohibited = shall not | must not
        permits/exempt = is exempt from
        grants/permitted = has the right to | are entitled to
        defines/definitional = is defined as
        repeals/void = repealed by
        supersedes/null = supersedes
        imposes/obliged = shall | must
        prohibits/prohibited = may not
        permits/permitted = may
        defines/definitional = means
        prohibits/prohibited = darf nicht | ist untersagt | ist verboten
        grants/permitted = hat das Recht | ist berechtigt
        permits/permitted = ist zulässig
        defines/definitional = gilt als | bezeichnet | im Sinne dieser
        imposes/obliged = muss | hat zu
        permits/permitted = darf | kann
        """,
        dimensions="causal: permits prohibits; intentional: grants imposes; relational: holds; structural: conditions defines delegates; temporal: repeals supersedes",
        predicates="conditions defines delegates grants holds imposes permits prohibits repeals supersedes",
        modalities="definitional exempt null obliged permitted prohibited proposal recommendation void",
        normative="null proposal recommendation",
        cues="universal: each|every|all |any |jede|alle|jeder; existential: at least one|mindestens ein|at least",
        verbs="bezeichnet|gilt als|im sinne dieser|is defined as|means|shall mean",
        schemes="celex doi arxiv",
        principles="data-subject-empowerment effective-remedies effectiveness fundamental-rights harmonisation high-level-of-protection internal-market-functioning legal-certainty proportionality rule-of-law subsidiarity transparency",
        canons="historical literal null systematic teleological",
        rules="analogical:eu_law lex_posterior lex_specialis lex_superior modus_ponens precedent:cjeu precedent:ecthr statutory_interpretation:historical statutory_interpretation:literal statutory_interpretation:systematic statutory_interpretation:teleological unspecified",
        ranks="0: charter:eu treaty:eu; 1: decision:eu directive:eu regulation:eu; 2: opinion:eu recommendation:eu; None: case-law:cjeu case-law:ecthr case-law:efta-court",
    ),
    _profile(
        "scholarly", "sch", "scholarly-v0",
        markers="""
        defines/definitional = is defined as | we define | refers to | is defined | denotes | definiert als | bezeichnet | bedeutet | means
        asserts/asserted = we argue that | we claim that | we show that | we find that | it follows that | demonstrates that | shows that | argues that | holds that | wir argumentieren | wir zeigen | zeigt, dass
        asserts/hypothesized = we hypothesize | we conjecture | suggests that | may indicate | might | vermutlich
        relates/asserted = is associated with | correlates with | is related to | depends on | corresponds to | hängt ab von | korreliert mit
        causes/asserted = gives rise to | leads to | results in | causes | produces | führt zu | verursacht | bewirkt
        enables/asserted = makes possible | enables | allows | facilitates | ermöglicht | erlaubt
        prevents/asserted = rules out | prevents | precludes | inhibits | verhindert | schließt aus
        supports/asserted = is evidence for | is consistent with | supports | confirms | corroborates | stützt | bestätigt
        refutes/asserted = is inconsistent with | contradicts | refutes | challenges | undermines | widerlegt | widerspricht
        """,
        dimensions="causal: causes enables prevents; relational: asserts refutes relates supports; structural: defines",
        predicates="asserts causes defines enables prevents refutes relates supports",
        modalities="asserted definitional hypothesized null",
        normative="hypothesized",
        cues="universal: every|all |each|any |always|jede|alle; existential: at least|some |there exists|mindestens",
        verbs="bezeichnet|definiert als|denotes|is defined as|means|refers to",
        schemes="doi arxiv",
        principles="",
        canons="null",
        rules="abduction analogy induction modus_ponens unspecified",
        ranks="",
    ),
    _profile(
        "news", "news", "news-v0",
        markers="""
        announced/reported = announced
        proposed/reported = proposed
        enacted/asserted = has enacted | enacted
        ruled/asserted = ruled
        fined/asserted = fined
        launched/reported = launched
        published/asserted = published
        withdrawn/asserted = withdrew | withdrawn
        """,
        dimensions="causal: fined; intentional: proposed; relational: announced ruled; temporal: enacted launched published withdrawn",
        predicates="announced enacted fined launched proposed published ruled withdrawn",
        modalities="asserted null reported",
        normative="",
        cues="universal: every|all |each; existential: at least|at least one",
        verbs="",
        schemes="",
        principles="",
        canons="null",
        rules="unspecified",
        ranks="",
    ),
    _profile(
        "delegation", "dlg", "delegation-v0",
        markers="""
        delegates/asserted = on behalf of | acting for | appoints
        mandates/asserted = for the purpose of | for the purposes of | in order to
        authorises/asserted = is authorised to | is authorized to | is instructed to
        restricts/asserted = solely for | only for | and for no other purpose | must not be used for
        consigns/asserted = is disclosed to | is transferred to | shall be provided to
        revokes/asserted = revokes | withdraws | terminates the appointment
        """,
        dimensions="causal: revokes; intentional: mandates restricts; relational: authorises consigns delegates",
        predicates="authorises consigns delegates mandates restricts revokes",
        modalities="asserted definitional hypothesized null",
        normative="",
        cues="universal: each|every|all |any ; existential: at least one|at least",
        verbs="is defined as|means",
        schemes="",
        principles="",
        canons="null",
        rules="abduction analogy induction modus_ponens unspecified",
        ranks="",
    ),
    # function words of the generated corpora as markers: there, the profiles above find nothing
    _profile(
        "synthetic", "syn", "synthetic-v1",
        markers="""
        defines/asserted = is | ist | est
        asserts/asserted = was
        relates/asserted = with | con
        enables/hypothesized = for | pour
        causes/asserted = from
        refutes/asserted = nicht
        """,
        dimensions="causal: causes enables; relational: asserts refutes relates; structural: defines",
        predicates="asserts causes defines enables refutes relates",
        modalities="asserted hypothesized null",
        normative="hypothesized",
        cues="universal: and the |und der ; existential: of a |eine ",
        verbs="is|ist|est",
        schemes="doi arxiv",
        rules="unspecified",
    ),
)

_REGISTRY: dict[str, Profile] = {}


def register(profile: Profile) -> Profile:
    _REGISTRY[profile.id] = profile
    return profile


def get(name: str) -> Profile:
    if name not in _REGISTRY:
        raise KeyError(f"unknown profile {name!r}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name]


for _p in BUILT_IN:
    register(_p)

#: Words of grammar that can't name a concept, for coordinates (English, German, French, Spanish).
CANON_WORDS = frozenset(
    """
a all als also am an and any are as at auch aus avec be been bei beim being bis both but by bzw can como con
could dabei damit dans das dass del dem den der deren des dessen die diese dieser dieses du durch each ein
eine einem einer eines el et for from fuer her his if ihre ihrer im in into is ist it its kein keine la las le
les los may mit more most nach ne nicht no noch nor not nur oder of on only onto or other ou our par para pas
per por pour que qui same schon se seine seiner should sich sind so sowie su such sur than that the their them
then these they this those to ueber um un una und une unter via vom von war waren was we wenn werden were what
when where whether which while who wie wird with within without wo wobei would you your zum zur
""".split()
)
#: The same for mined terms (English, German); the two lists differ.
MINING_WORDS = frozenset(
    """
aber about above abs after again against all alle als also am an and andere anderem anderen anderer anderes
any are auch auf aus been before bei beim being below bereits between bis both but bzw can could damit dann
darf das dass dem den denen denn der des did die dies diese diesem dieser dieses does doing dort duerfen durch
durfte during each ein eine einem einen einer eines einige etwa euer eure few first for from fuer further
gegen ggf haben habt had has hat hatte hatten have her here hier his how ihm ihn ihnen ihr ihre ihrer im in
inkl into ist its jede jeder jedes jedoch jene jener jenes just kann kein keine koennen koennt konnte mag man
manche may mehr meist might mit moegen more most muessen muss musste must nach nicht noch not nr nur oder ohne
once one only onto other our over own same schon second sehr sein seine seinem seinen seiner shall should sich
sie siehe sind sofern solche soll sollen sollte some soweit sowie such than that the their then there these
this those three through too two ueber um und under unser unsere unter very vgl vom von vor war waren was weil
welche wenn werden were what when where which while who whom why wie will wird with wollen wollte would wurde
wurden your ziff zu zum zur zwischen
""".split()
)
