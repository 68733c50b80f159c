"""French word lists.  Fixed values: they decide which words count, and must be exactly these."""

from __future__ import annotations

#: Function words: articles, prepositions, conjunctions, pronouns, and the forms of être and avoir.
STOPWORDS = frozenset(
    """
    les des une aux ces cet cette mes tes ses nos vos mon ton son notre votre leur leurs quel quelle quels quelles
    quelque quelques chaque plusieurs aucun aucune tout tous toute toutes même mêmes dans par pour sur sous avec
    sans chez vers entre contre depuis pendant devant derrière avant après selon malgré parmi dès jusque jusqu
    durant hors envers mais donc car que qui quoi dont où comme quand lorsque lorsqu puisque puisqu quoique quoiqu
    parce elle elles ils nous vous lui eux moi toi soi celui celle ceux celles cela ceci ça lequel laquelle
    lesquels lesquelles duquel auquel auxquels auxquelles voici voilà pas plus être suis est sommes êtes sont
    étais était étions étiez étaient fus fut fûmes fûtes furent serai seras sera serons serez seront serais serait
    serions seriez seraient sois soit soyons soyez soient fusse fusses fût fussions fussiez fussent été étant
    avoir avons avez ont avais avait avions aviez avaient eus eut eûmes eûtes eurent aurai auras aura aurons aurez
    auront aurais aurait aurions auriez auraient aies ait ayons ayez aient eue eues eusse eusses eût eussions
    eussiez eussent ayant
    """.split()
)

#: Irregular verbs: infinitive (the first spelling is the key), forms by tense, stems of the imperfect and the future,
#: prefixes of compounds; bound: no verb without a prefix; noun_like: forms that are nouns first unless prefixed.
IRREGULAR_VERBS = (
    {
        "infinitive": "aller",
        "present": "vais vas va allons allez vont",
        "imperfect": "all",
        "future": "ir",
        "past": "allai allas alla allâmes allâtes allèrent",
        "subjunctive": "aille ailles aillent allât",
        "participles": "allant allé allée allés allées",
    },
    {
        "infinitive": "faire",
        "present": "fais fait faisons faites font",
        "imperfect": "fais",
        "future": "fer",
        "past": "fis fit fîmes fîtes firent",
        "subjunctive": "fasse fasses fassent fassions fassiez fît",
        "participles": "faisant fait faits faite faites",
        "compounds": "dé re satis",
    },
    {
        "infinitive": "pouvoir",
        "present": "peux peut pouvons pouvez peuvent",
        "imperfect": "pouv",
        "future": "pourr",
        "past": "pus put pûmes pûtes purent",
        "subjunctive": "puisse puisses puissent puissions puissiez pût",
        "participles": "pouvant pu",
    },
    {
        "infinitive": "vouloir",
        "present": "veux veut voulons voulez veulent",
        "imperfect": "voul",
        "future": "voudr",
        "past": "voulus voulut voulûmes voulûtes voulurent",
        "subjunctive": "veuille veuilles veuillent veuillons veuillez voulût",
        "participles": "voulant voulu voulue voulus voulues",
    },
    {
        "infinitive": "savoir",
        "present": "sais sait savons savez savent",
        "imperfect": "sav",
        "future": "saur",
        "past": "sus sut sûmes sûtes surent",
        "subjunctive": "sache saches sachent sachions sachiez sachons sachez sût",
        "participles": "sachant su sus",
    },
    {
        "infinitive": "voir",
        "present": "vois voit voyons voyez voient",
        "imperfect": "voy",
        "future": "verr",
        "past": "vîmes vîtes virent",
        "subjunctive": "vît",
        "participles": "voyant vu vue vus vues",
    },
    {
        "infinitive": "devoir",
        "present": "dois doit devons devez doivent",
        "imperfect": "dev",
        "future": "devr",
        "past": "dus dut dûmes dûtes durent",
        "subjunctive": "doive doives doivent dût",
        "participles": "dû due dus dues",
    },
    {
        "infinitive": "dire",
        "present": "dis dit disons dites disent",
        "imperfect": "dis",
        "future": "dir",
        "past": "dis dit dîmes dîtes dirent",
        "subjunctive": "dise dises disent disions disiez dît",
        "participles": "disant dit dite dits dites",
        "compounds": "contre inter pré re",
    },
    {
        "infinitive": "venir",
        "present": "viens vient venons venez viennent",
        "imperfect": "ven",
        "future": "viendr",
        "past": "vins vint vînmes vîntes vinrent",
        "subjunctive": "vienne viennes viennent vînt",
        "participles": "venant venu venue venus venues",
        "compounds": "de re par con sur pré inter pro sou",
    },
    {
        "infinitive": "tenir",
        "present": "tiens tient tenons tenez tiennent",
        "imperfect": "ten",
        "future": "tiendr",
        "past": "tins tint tînmes tîntes tinrent",
        "subjunctive": "tienne tiennes tiennent tînt",
        "participles": "tenant tenu tenue tenus tenues",
        "compounds": "con dé main ob re sou entre appar abs",
    },
    {
        "infinitive": "prendre",
        "present": "prends prend prenons prenez prennent",
        "imperfect": "pren",
        "future": "prendr",
        "past": "pris prit prîmes prîtes prirent",
        "subjunctive": "prenne prennes prennent prît",
        "participles": "prenant pris prise prises",
        "compounds": "ap com re sur entre",
    },
    {
        "infinitive": "mettre",
        "present": "mets met mettons mettez mettent",
        "imperfect": "mett",
        "future": "mettr",
        "past": "mis mit mîmes mîtes mirent",
        "subjunctive": "mette mettes mettent mît",
        "participles": "mettant mis mise mises",
        "compounds": "ad com dé é o per pro re sou trans",
    },
    {
        "infinitive": "croire",
        "present": "crois croit croyons croyez croient",
        "imperfect": "croy",
        "future": "croir",
        "past": "crut crûmes crûtes crurent",
        "subjunctive": "croie croies croient croyions croyiez crût",
        "participles": "croyant cru",
    },
    {
        "infinitive": "boire",
        "present": "bois boit buvons buvez boivent",
        "imperfect": "buv",
        "future": "boir",
        "past": "bûmes bûtes burent",
        "subjunctive": "boive boives boivent bût",
        "participles": "buvant bu bue bues",
        "noun_like": "bois",
    },
    {
        "infinitive": "lire",
        "present": "lis lit lisons lisez lisent",
        "imperfect": "lis",
        "future": "lir",
        "past": "lus lut lûmes lûtes lurent",
        "subjunctive": "lise lises lisent lût",
        "participles": "lisant lu lue lus lues",
        "compounds": "re é",
        "noun_like": "lit",
    },
    {
        "infinitive": "crire",
        "present": "cris crit crivons crivez crivent",
        "imperfect": "criv",
        "future": "crir",
        "past": "crivis crivit crivîmes crivîtes crivirent",
        "subjunctive": "crive crives crivent crivît",
        "participles": "crivant crit crite crits crites",
        "compounds": "é dé",
        "bound": True,
    },
    {
        "infinitive": "suivre",
        "present": "suit suivons suivez suivent",
        "imperfect": "suiv",
        "future": "suivr",
        "past": "suivis suivit suivîmes suivîtes suivirent",
        "subjunctive": "suive suives suivent suivît",
        "participles": "suivant suivi suivie suivis suivies",
        "compounds": "pour",
    },
    {
        "infinitive": "vivre",
        "present": "vivons vivez vivent",
        "imperfect": "viv",
        "future": "vivr",
        "past": "vécus vécut vécûmes vécûtes vécurent",
        "subjunctive": "vivent vécût",
        "participles": "vivant vécu vécue vécus vécues",
        "compounds": "sur re",
    },
    {
        "infinitive": "connaître connaitre",
        "present": "connais connaît connait connaissons connaissez connaissent",
        "imperfect": "connaiss",
        "future": "connaîtr connaitr",
        "past": "connus connut connûmes connûtes connurent",
        "subjunctive": "connaisse connaisses connût",
        "participles": "connaissant connu connue connus connues",
        "compounds": "re mé",
    },
    {
        "infinitive": "paraître paraitre",
        "present": "parais paraît parait paraissons paraissez paraissent",
        "imperfect": "paraiss",
        "future": "paraîtr paraitr",
        "past": "parus parut parûmes parûtes parurent",
        "subjunctive": "paraisse paraisses parût",
        "participles": "paraissant paru parue parus parues",
        "compounds": "ap dis com trans",
    },
    {
        "infinitive": "mourir",
        "present": "meurs meurt mourons mourez meurent",
        "imperfect": "mour",
        "future": "mourr",
        "past": "mourus mourut mourûmes mourûtes moururent",
        "subjunctive": "meure meures meurent mourût",
        "participles": "mourant mort morte morts mortes",
    },
    {
        "infinitive": "cevoir",
        "present": "çois çoit cevons cevez çoivent",
        "imperfect": "cev",
        "future": "cevr",
        "past": "çus çut çûmes çûtes çurent",
        "subjunctive": "çoive çoives çoivent çût",
        "participles": "cevant çu çue çus çues",
        "compounds": "re aper con dé per",
        "bound": True,
    },
    {
        "infinitive": "valoir",
        "present": "vaux vaut valons valez valent",
        "imperfect": "val",
        "future": "vaudr",
        "past": "valus valut valûmes valûtes valurent",
        "subjunctive": "vaille vailles vaillent valût",
        "participles": "valant valu",
    },
    {
        "infinitive": "falloir",
        "others": "faut fallait fallut faudra faudrait faille fallût fallu",
    },
    {
        "infinitive": "rire",
        "present": "ris rit rions riez rient",
        "imperfect": "ri",
        "future": "rir",
        "past": "ris rit rîmes rîtes rirent",
        "subjunctive": "rie ries rient rît",
        "participles": "riant ri",
        "compounds": "sou",
    },
    {
        "infinitive": "asseoir assoir",
        "present": "assieds assied asseyons asseyez asseyent assois assoit assoyons assoyez assoient",
        "imperfect": "assey assoy",
        "future": "assiér assoir asseyer",
        "past": "assis assit assîmes assîtes assirent",
        "subjunctive": "asseye asseyes asseyent assoie assoies assoient assît",
        "participles": "asseyant assoyant assis assise assises",
    },
)

IMPERFECT_ENDINGS = ("ais", "ait", "ions", "iez", "aient")
FUTURE_ENDINGS = ("ai", "as", "a", "ons", "ez", "ont")

#: The forms of the two auxiliaries, for lexicon entries.
AUXILIARIES = {
    "être": frozenset(
        """
        être suis es est sommes êtes sont étais était étions étiez étaient fus fut fûmes fûtes furent serai
        seras sera serons serez seront serais serait serions seriez seraient sois soyons soyez soient fût étant
        """.split()
    ),
    "avoir": frozenset(
        """
        avoir ai as a avons avez ont avais avait avions aviez avaient eus eut eûmes eûtes eurent aurai auras
        aura aurons aurez auront aurais aurait aurions auriez auraient aie aies ait ayons ayez aient eût ayant
        eu
        """.split()
    ),
}

#: Endings of regular verbs in -er: present, imperfect, past, subjunctive; future, conditional; participles, infinitive.
ER_ENDINGS = tuple("e es ons ez ent ais ait ions iez aient ai as a âmes âtes èrent erai eras era erons erez eront erais erait erions eriez eraient ant é ée és ées er".split())

#: The default lexicon of weak words, in the notation of plumeline.sources.lexicon.
DEFAULT_LEXICON = """\
# Mots faibles

## Intensifs et atténuateurs

très, assez, plutôt, vraiment, tellement, un peu, presque, quelque peu, trop, tout à fait

## Adverbes en -ment (seuil 3)

*ment

sauf: moment, vêtement, mouvement, sentiment, document, logement, gouvernement, comment, bâtiment, instrument, appartement, ornement, élément, sacrement, testament, monument, argument, médicament, fragment, segment, commencement, changement, enseignement, événement, évènement, jugement, tempérament, tourment, tremblement, aliment, serment, ciment, firmament, parlement, règlement, emplacement, remplacement, déplacement, rassemblement, soulagement, avertissement, attachement, étonnement, bruissement, grondement, battement, claquement, craquement, effondrement, abattement, ameublement, engagement, divertissement, établissement, détachement, éloignement, ravissement, frémissement, gémissement, hennissement, vieillissement, apaisement, assoupissement, fonctionnement, environnement, traitement, rendement, paiement, déroulement, ressentiment, tiraillement, bourdonnement, chuchotement, ronflement, froment

## Verbes ternes (seuil 6)

@faire, @avoir, @être, @mettre, @aller, @sembler, @paraître, @commencer à, se @mettre à, @être en train de

## Mots vagues (seuil 2)

chose, choses, quelque chose, truc, trucs, machin, sorte de, genre, un certain, une certaine, espèce de

## Béquilles narratives

soudain, soudainement, tout à coup, tout d'un coup, puis, alors, comme si, peut-être
"""

#: Some of the most frequent full words of French prose (our own short choice): very common where no frequency table is given.
COMMON_WORDS = """
homme femme enfant fille garçon père mère frère soeur fils ami monsieur madame dame monde gens personne famille nom voix
main tête visage oeil yeux regard coeur corps bras pied jambe bouche cheveux front épaule doigt dos peau sang larme sourire
jour nuit matin soir heure minute moment temps fois année an mois semaine hier demain aujourd hui maintenant toujours jamais
maison chambre porte fenêtre table lit mur rue ville pays route chemin place jardin arbre forêt mer eau terre ciel soleil
vent feu lumière ombre pierre bois air bruit silence froid chaud blanc noir rouge bleu vert petit grand gros jeune vieux vieil
bon beau belle mauvais long haut bas nouveau seul premier dernier autre plein vide vrai faux fort doux dur clair sombre
chose mot parole histoire question idée vie mort amour peur joie guerre force raison part côté bout fond point fin
dire parler demander répondre regarder voir entendre sentir toucher prendre donner mettre tenir porter tirer pousser venir
aller partir sortir entrer rentrer passer arriver marcher courir monter descendre tomber rester attendre chercher trouver
savoir croire penser comprendre vouloir pouvoir devoir falloir aimer vivre mourir ouvrir fermer jouer rire pleurer
quelqu presqu rien bien mal encore aussi trop peu beaucoup déjà loin près
"""
