"""How a sentence that declines a task is worded: a small logistic model over words and their roles.

The roles (who speaks, negation, ability, doing, the task, rules, regret) are word lists in four languages; which sequences of them
decline is learned from sentences put together here and from plain prose, not read off a corpus. The model only says how a sentence
sounds; whether it is a refusal is decided over its whole cluster, together with how it recurs (see defects).
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

from tallyforge.llm.languages import LINES
from tallyforge.llm.pii_grammar import labelled

# fixed values: words by role, in English, German, French and Spanish
ROLES = {
    "I": "i i'm i'd i'll i've we we're we'll we'd me my us myself assistant model ai system bot ich wir mir mich mein meine uns unser je j' j'ai nous moi mon ma mes yo mi nosotros me m",
    "NOT": "not no cannot can't couldn't won't wouldn't don't didn't doesn't isn't shouldn't never nothing neither nor unable without none nobody nicht kein keine keinen keinem keiner nie niemals weder pas ne n' aucun aucune jamais rien ni nunca ningún ninguna nada jamás",
    "CAN": "can could able may might will would shall should must have need going willing supposed designed meant in position kann können könnte darf dürfen werde werden will wollen möchte möchten muss müssen lage imstande peux puis pouvons vais allons veux voulons dois devons souhaite saurais capable mesure possible puedo podemos podré quiero debo debemos tengo voy capaz posible",
    "DECLINE": "decline refuse refusing declining abstain withhold reject pass skip sit turn down excuse opt ablehnen lehne lehnen verweigern verweigere passen absehen refuser refuse décliner décline rechazar rechazo niego negarme negarnos declinar declino abstengo abstenir abstiens",
    "DO": "ahead forward further help assist provide write produce complete fulfil fulfill fulfilled completed answered answer respond evaluate judge judging rate review reviewing do done doing take proceed comply continue comment engage offer give create generate discuss prepare handle process grant deal work touch weigh say share perform compose serve tackle helfen weiterhelfen beantworten verfassen schreiben erstellen bewerten beurteilen nachkommen erfüllen bearbeiten behilflich antworten liefern äußern leisten aider répondre rédiger écrire évaluer juger donner traiter satisfaire accéder faire fournir réaliser ayudar ayudarle responder redactar escribir evaluar juzgar valorar atender cumplir completar hacer ofrecer ayudarte realizar",
    "TASK": "task request prompt question message email mail reply text assessment rating verdict evaluation matter topic one this that it here content kind subject job order piece inquiry aufgabe anfrage bitte frage diese diesen dieser dieses das dazu hierbei hier dabei thema inhalt demande tâche requête question cette ce cela ceci sujet contenu solicitud tarea petición pregunta esta este esto eso tema contenido",
    "RULE": "guidelines guideline policy policies rules rule instructions principles safety permitted allowed authorized authorised authority remit scope limits limit outside beyond against comfortable appropriate qualified competence responsibility mandate role line bounds boundaries breach conflict sensitive harmful prohibited forbid forbidden forbids prevents bar barred richtlinien vorgaben regeln befugt berechtigt erlaubt gestattet außerhalb zuständigkeit zuständig grenzen sicherheit untersagt verboten règles consignes directives autorisé autorisée permis dehors cadre compétence limites interdit sécurité normas directrices reglas autorizado autorizada permitido fuera alcance competencia límites prohibido seguridad",
    "SORRY": "sorry apologies apologise apologize unfortunately regret regrettably afraid forgive pardon alas leider entschuldigung entschuldigen bedaure bedauerlicherweise verzeihung désolé désolée malheureusement regrette excuses navré lamento siento lamentablemente perdón disculpe disculpas desgraciadamente",
    "YOU": "you your yours yourself sie ihnen ihr ihre ihrer du dir dein vous votre vos te toi usted ustedes su sus le tu",
}
ROLE: dict[str, str] = {}
for _role, _words in ROLES.items():
    for _w in _words.split():
        ROLE.setdefault(_w, _role)

# parts of declining sentences; {D} something to do, {T} the task, {W} a reason
PARTS = {
    "en": {
        "S": "|sorry, |sorry, but |I'm sorry, |I'm sorry, but |I apologize, but |unfortunately, |regrettably, |I'm afraid |with regret, |thank you for asking, but |having read this, |I see what you want, but |I understand, yet ",
        "C": "I can't {D}|I cannot {D}|I am unable to {D}|I'm not able to {D}|I won't {D}|I will not {D}|I am not allowed to {D}|I'm not permitted to {D}|I must decline to {D}|I have to refuse to {D}|I refuse to {D}|I decline to {D}|I would rather not {D}|I'd prefer not to {D}|I am not willing to {D}|I do not feel able to {D}|I'm not in a position to {D}|it is not possible for me to {D}|we cannot {D}|we are unable to {D}|this assistant can't {D}|the assistant will not {D}|as an AI I cannot {D}|as a language model I can't {D}|I may not {D}|I should not {D}|I don't feel comfortable having to {D}|I am going to decline {T}|I have to turn down {T}|I must pass on {T}|I have to say no to {T}|I will sit out {T}|I'll have to skip {T}|{T} is outside my remit|{T} falls beyond my scope|{T} is off limits for me|{T} is not something I can do|{T} is not something I do|{T} goes against my guidelines|{T} lies outside what I am allowed to do|{T} cannot be answered by me|{T} can't be completed here|{T} will not be answered|there will be no answer to {T} from me|no reply to {T} can be given|my rules do not let me {D}|my instructions forbid me to {D}|my guidelines prevent me from helping|please do not ask me to {D}|don't expect me to {D}|I can offer no help with {T}|I have no authority to {D}|I lack permission to {D}|I'm the wrong one for {T}|I leave {T} undone|I'd prefer to leave {T} undone|I need to decline {T}|I need to turn down {T}|I need to say no|I'm not comfortable with {T}|I do not feel comfortable with {T}|{T} is not one for me|the answer to {T} has to be no|I prefer to leave {T} unanswered|my answer to {T} is no|I can neither answer nor {D}|count me out of {T}|you will have to ask someone else to {D}|that is not a task I will take on|I withhold my judgement on {T}|I abstain from {T}|{T} is not one I can {D}|{T} stays undone|{T} will stay unanswered|{T} will stay unwritten|I'm leaving {T} blank|you won't get {T} from me|I won't be giving {T}|nothing on {T} will come from me|it's a no from me on {T}|I'd rather leave {T} alone|better not ask me about {T}|I keep out of {T}|I have no business with {T}",
        "D": "help|help with {T}|assist with {T}|do {T}|answer {T}|write {T}|complete {T}|produce {T}|comment on {T}|take on {T}|give an opinion on {T}|evaluate {T}|judge {T}|review {T}|fulfil {T}|respond to {T}|discuss {T}|go on with {T}|comply|provide {T}|handle {T}|create {T}|rate {T}|draft {T}|prepare {T}|engage with {T}|proceed with {T}|carry on with {T}|move forward with {T}|go ahead|go any further|take part in {T}|weigh in on {T}|have a view on {T}|be of help here",
        "T": "this|that|it|this request|your request|the request|this task|that question|this question|such a text|a message of this kind|this topic|this matter|that sort of content|the rating|this review|the email|a reply|a verdict|an assessment|the draft|that prompt|this one|what you ask for|work like this",
        "W": "||||.|, as it would break my rules|, because my guidelines forbid it| for safety reasons| under my policy|, as I lack the permission|; please ask someone else| without approval|, since it could cause harm|, because it concerns private people|; a person should do it",
    },
    "de": {
        "S": "|leider |es tut mir leid, aber |entschuldigung, |ich bedaure, aber |tut mir leid, ",
        "C": "ich kann {T} nicht {D}|ich darf {T} nicht {D}|ich werde {T} nicht {D}|kann ich {T} nicht {D}|darf ich {T} nicht {D}|wir können {T} nicht {D}|ich möchte {T} lieber nicht {D}|ich muss {T} ablehnen|ich lehne {T} ab|muss ich {T} ablehnen|ich bin nicht befugt, {T} zu {D}|ich bin nicht in der Lage, {T} zu {D}|mir ist es nicht erlaubt, {T} zu {D}|meine Richtlinien erlauben es nicht, {T} zu {D}|{T} liegt außerhalb meiner Zuständigkeit|als KI kann ich {T} nicht {D}|ich verweigere {T}|dabei kann ich nicht helfen|damit kann ich nicht dienen|hierbei kann ich Ihnen nicht weiterhelfen|dazu darf ich mich nicht äußern|das übernehme ich nicht|{T} kann von mir nicht bearbeitet werden",
        "D": "beantworten|bearbeiten|erfüllen|schreiben|bewerten|beurteilen|verfassen|erstellen|übernehmen|kommentieren", "T": "das|dies|diese Anfrage|diese Bitte|diese Aufgabe|die Frage|diesen Text|eine solche Nachricht|diese Bewertung", "W": "||., da es gegen meine Regeln verstößt| aus Sicherheitsgründen|, weil mir die Erlaubnis fehlt",
    },
    "fr": {
        "S": "|malheureusement, |désolé, |désolé, mais |je regrette, mais |je suis navré, mais ",
        "C": "je ne peux pas {D} {T}|je ne suis pas en mesure de {D} {T}|je ne suis pas autorisé à {D} {T}|je refuse de {D} {T}|je dois refuser de {D} {T}|je dois décliner {T}|je préfère ne pas {D} {T}|nous ne pouvons pas {D} {T}|il m'est impossible de {D} {T}|je ne souhaite pas {D} {T}|{T} dépasse mon cadre|{T} est hors de ma compétence|mes règles m'interdisent de {D} {T}|en tant qu'IA, je ne peux pas {D} {T}|je ne vais pas {D} {T}|je ne saurais {D} {T}|je ne peux pas vous aider|je ne donnerai pas de réponse à {T}",
        "D": "traiter|rédiger|évaluer|juger|faire|écrire|accepter|commenter|fournir", "T": "cela|cette demande|votre demande|cette tâche|ce message|ce texte|une telle réponse|cette question|ce type de contenu", "W": "|||, car mes règles l'interdisent| pour des raisons de sécurité|; adressez-vous à quelqu'un d'autre",
    },
    "es": {
        "S": "|lamentablemente, |lo siento, |lo siento, pero |lamento decir que |disculpe, pero ",
        "C": "no puedo {D} {T}|no podemos {D} {T}|no me es posible {D} {T}|no estoy autorizado a {D} {T}|no voy a {D} {T}|debo rechazar {T}|tengo que rechazar {T}|me niego a {D} {T}|prefiero no {D} {T}|no me está permitido {D} {T}|{T} está fuera de mi alcance|mis normas no permiten {D} {T}|como modelo de lenguaje no puedo {D} {T}|no estoy en condiciones de {D} {T}|no quiero {D} {T}|no puedo ayudarle con {T}|declino {T}",
        "D": "responder a|escribir|redactar|evaluar|juzgar|atender|completar|hacer|comentar|cumplir", "T": "esto|eso|esta solicitud|su solicitud|esta tarea|este mensaje|un texto así|esa pregunta|esta petición", "W": "|||, porque va contra mis normas| por seguridad|; pregunte a otra persona",
    },
}
#: Plain prose that holds the same words without declining the task.
PLAIN = """
We can't start before May.|I can't find the file you sent.|We cannot offer more than two people.|I will not be in the office on Friday.|I'm not sure about the price.|I don't know who signed it.|We won't need the car after all.|I must leave early today.|I have to take the late train.|Please don't call me before noon.|
I would rather meet on Tuesday.|I'd prefer tea to coffee.|We are unable to ship before the holidays.|They refuse to pay the invoice.|The customer declined the second offer.|She declines to name a price.|He cannot read the text without glasses.|The reply does not answer the question.|This answer is not complete.|
The draft can't be longer than a page.|The text is not in line with the rules.|The message breaks the style guide.|The review is not finished.|The rating is too low for such a text.|No verdict was given last year.|The request was answered in time.|My task is to write the summary.|I can help you with this.|I will answer your question tomorrow.|
We can do this for you.|I am happy to assist.|I could write a shorter text.|Let me review it again.|I would judge this as fair.|I would keep the first sentence.|I do not agree with the rating.|I don't think it is wrong.|I do not see a reason to change it.|I did not mean to press you.|I won't press you for a date.|
You do not have to decide now.|You cannot lose anything.|No answer is needed.|There is no need to reply.|There is no hurry.|Not all seats are free.|Nothing has changed since then.|None of the names is right.|It is not a promise.|It is not possible to see the source.|The claim is not supported.|The writer does not promise anything.|
The mail promises more than the sheet allows.|The author should not state this as fact.|The second line must be cut.|The tone is not rude.|It may be out of date.|It can be done in two weeks.|It will not cost more.|The rules allow one question.|The guidelines ask for a short subject.|The policy was followed.|The limit is ninety words.|
Sorry for the late reply.|Sorry that you had to wait.|I apologize for the delay.|Unfortunately, the room is taken.|Unfortunately, the dates do not match.|I'm afraid the train is late.|I regret the mistake in the invoice.|Thank you for your patience.|Thanks for the details.|Please ask a colleague.|Feel free to write again.|Please let me know.|
Could you tell me more?|Would Thursday suit you?|Is there anything else?|Can I send you a sample?|Why not try it for a month?|We have no free people in June.|We have to wait for the approval.|We need a decision by Monday.|We should not hire too fast.|We may be able to begin sooner.|I am able to come on Monday.|I was not able to open the door.|
I have passed the note on to our team.|He passed the test.|It fails the check.|Pass, because both points hold.|Fail, because the number is wrong.|It does not pass, as no source is named.|I rate it three of five.|My verdict is a pass.|The verdict is no.|No, the numbers differ.|Yes, it is within the limit.|I answered no to the second point.|
I do not want to take your time.|I don't want to rush you.|I do not expect a reply today.|I can't promise a date yet.|We can't say more until the contract is signed.|I cannot confirm the number.|We could not reach you by phone.|I am not the right person for billing, but our office will help.|My colleague will take over this task.|
We decline orders below ten pieces.|The offer is outside our budget.|That is beyond the plan for this year.|The garden is off limits for dogs.|It is against the law to park here.|The bank refused the loan.|Nobody has to work on Sunday.|I skip lunch on busy days.|In my opinion the price is fair.|The report can't prove the point, so it was sent back.|The study cannot back this number.|The list doesn't hold the name.|This page can't explain the drop, so it must be cut.|The bridge cannot carry trucks.|The author can't know this.|The table could not hold more rows because it was full.|The evidence does not reach that far.|The sum cannot be right.|One source can't bear such a claim.|The machine can't lift the box, so two men are needed.|Die Quelle kann die Zahl nicht belegen.|Leider fällt der Kurs aus, wir rufen Sie später an.|Der Plan passt uns nicht.|La source ne peut pas prouver ce chiffre.|La fuente no puede probar la cifra.|My impression is that it works.|You wrote that the room was cold.|You asked for a view on the price, and I think it is fair.|I would say the text is sound.|My comment: the number is too high.|As I see it, the second point is weak.|Here is my answer: yes.|I find the reply polite.|You said that it may rain, and it did.|My reading of the sheet is another one.|
I turned down the music.|The path goes down to the lake.|
Wir können nicht vor Mai beginnen.|Ich kann die Datei nicht finden.|Leider ist der Raum belegt.|Ich bin am Freitag nicht im Büro.|Wir brauchen noch eine Antwort.|Das ist leider zu teuer.|Ich werde Ihnen morgen antworten.|Die Antwort ist nicht vollständig.|Der Text darf nicht länger sein.|Wir lehnen kleine Bestellungen ab.|Ich möchte lieber am Dienstag kommen.|Es gibt keine freien Plätze.|Der Ton ist nicht zu hart.|Die Frage bleibt offen.|Wir können den Preis nicht halten, aber ein Rabatt ist möglich.|Ich kann den Termin nicht bestätigen.|Ich kann heute nicht kommen, aber morgen habe ich Zeit.|Wir dürfen hier nicht parken.|Das Haus können wir nicht kaufen.|Wir können nicht jeden Wunsch halten, aber vieles geht.|Sie müssen nicht sofort entscheiden.|
Nous ne pouvons pas commencer avant mai.|Je ne trouve pas le fichier.|Malheureusement, la salle est prise.|Je ne serai pas au bureau vendredi.|Je préfère venir mardi.|La réponse n'est pas complète.|Le texte ne doit pas être plus long.|Je vous répondrai demain.|Il n'y a pas de place libre.|Le ton n'est pas trop dur.|La question reste ouverte.|C'est trop cher pour nous.|Je ne connais pas encore la date.|Je ne peux pas confirmer la date, mais la semaine suivante est libre.|Nous ne pouvons pas garder ce prix.|Je ne peux pas venir aujourd'hui.|Vous ne devez pas décider tout de suite.|
No podemos empezar antes de mayo.|No encuentro el archivo.|Lamentablemente, la sala está ocupada.|No estaré en la oficina el viernes.|Prefiero venir el martes.|La respuesta no está completa.|El texto no debe ser más largo.|Le responderé mañana.|No hay plazas libres.|El tono no es demasiado duro.|La pregunta queda abierta.|Es demasiado caro para nosotros.|No conozco todavía la fecha.|No puedo confirmar la fecha, pero la semana siguiente está libre.|No podemos mantener ese precio.|Hoy no puedo venir.|Usted no debe decidir ahora.
""".replace("\n", "").split("|")

TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def tokens(sentence: str) -> list[str]:
    return TOKEN.findall(sentence.lower().replace("’", "'"))


def features(words: list[str]) -> list[str]:
    """Words, pairs of neighbours, roles, their ordered pairs within six words and triples of the sequence of roles."""
    roles = []
    for w in words:
        r = ROLE.get(w)
        if r is None and "'" in w:
            head, tail = w.split("'", 1)
            r = "NOT" if tail == "t" else ROLE.get(tail) or ROLE.get(head)
        roles.append(r or ("NEG" if w[:2] in ("un", "in") and len(w) > 6 else "-"))
    out = [f"w={w}" for w in words] + [f"b={a} {b}" for a, b in zip(words, words[1:], strict=False)] + [f"begin={roles[0] if roles else ''}", f"long={min(len(words) // 6, 5)}"]
    seq = [r for i, r in enumerate(roles) if r != "-" and (i == 0 or roles[i - 1] != r)]
    out += [f"r={r}" for r in set(seq)] + [f"t={a} {b} {c}" for a, b, c in zip(seq, seq[1:], seq[2:], strict=False)]
    near = {(a, b) for i, a in enumerate(roles) if a != "-" for b in roles[i + 1 : i + 7] if b != "-"}
    out += [f"p={a} {b}" for a, b in near]
    out += [f"h={w} {r}" for i, w in enumerate(words) if roles[i] == "-" and len(w) > 2 for r in {*roles[max(0, i - 3) : i + 4]} - {"-"}]
    return list(dict.fromkeys(out))


def sentences(n: int, seed: int) -> list[tuple[str, bool]]:
    """n declining sentences in four languages, half of them English, all the plain ones, and as much office prose."""
    rng = random.Random(seed)
    pick = lambda lang, k: rng.choice(PARTS[lang][k].split("|"))
    out = []
    for _ in range(n):
        lang = rng.choice(("en", "en", "en", "de", "fr", "es"))
        s = pick(lang, "S") + pick(lang, "C") + (pick(lang, "W") if rng.random() < 0.6 else "")
        for slot in ("D", "T"):
            while "{" + slot + "}" in s:
                s = s.replace("{" + slot + "}", pick(lang, slot), 1)
        out.append((s, True))
    plain = [p.strip() for p in PLAIN if p.strip()] + [p.strip() for text in LINES.values() for p in re.split(r"(?<=[.?!])\s", text) if p.strip()]
    prose = [p.strip() for text, _ in labelled([], [], n, seed) for p in re.split(r"(?<=[.?!])\s|\n", text) if len(p.split()) > 2]
    return out + [(p, False) for p in plain] + [(p, False) for p in prose[:n]]


class Wording:
    """Log odds that a sentence declines, by logistic regression with a ridge; the same for the same seed."""

    def __init__(self, n: int = 1500, epochs: int = 12, seed: int = 5):
        data = [(features(tokens(s)), y) for s, y in sentences(n, seed)]
        share = sum(y for _, y in data) / len(data)
        weight, squares, rng = defaultdict(float), defaultdict(lambda: 1.0), random.Random(seed)
        self.bias = 0.0
        for _ in range(epochs):
            rng.shuffle(data)
            for fs, y in data:
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + sum(weight[f] for f in fs)))))
                g = (y - p) * (0.5 / share if y else 0.5 / (1 - share))
                self.bias += 0.02 * g
                if abs(g) > 1e-3:
                    for f in fs:
                        squares[f] += g * g
                        weight[f] += 0.15 * (g - 2e-3 * weight[f]) / math.sqrt(squares[f])
        self.weight = {f: w for f, w in weight.items() if abs(w) > 1e-3}

    def __call__(self, sentence: str) -> float:
        get = self.weight.get
        return self.bias + sum(get(f, 0.0) for f in features(tokens(sentence)))
