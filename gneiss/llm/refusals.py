"""Refusals by a grammar of declining, in three languages (part of problem 3).

A refusal is told by its parts of speech, not by set phrases: who speaks, that something is
denied, what act of speech is denied or given up, which object (this question, the sources) it
concerns. Words and short groups of each class are the patterns of one Aho-Corasick automaton
a language; rules over the classes of one sentence decide.
"""

from __future__ import annotations

import re
from functools import lru_cache

from gneiss.llm.text import folded, plain

# Words of each class. SPEAKER speaks for the answering side; NOT denies,
# DENIED an ability, permission or will; ACT is an act of answering; GIVES_UP is an act of declining;
# ASKED is the request at hand; BEYOND and DOMAIN say that it is another's field; SOURCE and
# LACKS that the texts don't tell, with TELL in a denial; UNTOLD that there is no answer; SELF is one person speaking,
# HEDGE what such a person holds true; IGNORES that the speaker doesn't
# know; MOVE and ELSEWHERE change the subject; HANDS and UNIT hand the question over; BARS is
# a rule that keeps the speaker from it; NOBASIS misses grounds; BARE refuses by itself;
# OUGHT starts another statement, in which an act of answering is no longer denied.
GRAMMAR: dict[str, dict[str, str]] = {
    "en": {
        "OUGHT": "must|should|shall|has to|have to|need to|needs to|ought to",
        "SPEAKER": "i|me|my|myself|we|us|our|ours|this assistant|this model|this service",
        "NOT": "not|cannot|can t|don t|doesn t|won t|wouldn t|couldn t|isn t|didn t|haven t|unable|never|no|nothing|hard for|difficult for|without|nor|neither|inappropriate|impossible|wrong for|hardly",
        "DENIED": "cannot|can not|can t|could not|couldn t|unable|not able|won t|will not|wouldn t|would not|may not|must not|not allowed|not permitted|not authorised|not authorized|not in a position|not at liberty|not free to|not willing|not going to|not possible|impossible|not feel able|not supposed|not entitled|not qualified|not competent|no permission|no right|not something|do not wish|don t wish|don t want|do not want|choose not|chosen not|no way",
        "SELF": "i|me|my|mine|myself",
        "HEDGE": "think|believe|suppose|guess|understand|assume|recall|see why",
        "TELL": "tell|tells|answer|answers|find|found|see|indicate|indicates|show|shows|settle|settles|support|supports|information|indication|hint|clue|specify|specifies|explain|explains|reveal|give|gives|help",
        "ACT": "answer|answers|answering|answered|respond|responding|reply|replying|help|helping|assist|assisting|comment|commenting|comments|discuss|discussing|speak|speaking|say|saying|talk|talking|tell|telling|address|addressing|advise|advising|opinion|view|judge|judging|conclude|concluding|conclusion|determine|determining|confirm|confirming|decide on|process|share|deal with|dealt with|weigh in|derived|drawn|given|settle|settles|offer guidance|provide|go into|get into|take a position|take sides|information|guidance|handle|weigh|explain|speculate|guess|find|go any further|go further|be of help",
        "GIVES_UP": "decline|declining|declined|refuse|refusing|refused|refrain|refraining|abstain|abstaining|withhold|withholding|rather not|sooner not|prefer not|prefer to stay out|prefer to leave|prefer to skip|prefer to pass|prefer to keep|stay out of|keep out of|going to pass|pass on|have to pass|must pass|avoid|steer clear|leave that aside|leave this aside|opt not|leave that question|leave this question|leave the question|leave this to|leave that to|leave it to|keep silent|stay silent|remain silent|keep quiet|stay quiet|hold back|to myself|skip",
        "ASKED": "this question|that question|the question|question is|your question|questions of this|this request|that request|your request|the request|this inquiry|your inquiry|this topic|that topic|this subject|that subject|this point|this matter|that matter|the matter|that is|this is|of that|on that|about that|with that|on this|to this|here",
        "BEYOND": "outside|beyond|out of|not within|not part of|exceeds|not in|falls outside|no part of",
        "DOMAIN": "my remit|remit|my scope|scope of this assistant|competence|my expertise|my role|my task|purview|my field|my area|my domain|my mandate|my authority|my power|responsibility|what i can|what i may|what i am|what we can|what we may|what this service|what this assistant|what this model",
        "SOURCE": "source|sources|document|documents|evidence|text|texts|material|materials|passage|passages|excerpt|excerpts|context|file|files|records",
        "LACKS": "silent on|silent about|are silent|is silent|remain silent|remains silent|stay silent|nothing|no information|no mention|no evidence|insufficient|not enough|not sufficient|too little|do not contain|does not contain|don t contain|doesn t contain|do not mention|does not mention|don t mention|doesn t mention|do not say|does not say|don t say|doesn t say|do not cover|does not cover|do not state|does not state|do not address|does not address|do not tell|does not tell|lack|lacks|lacking",
        "UNTOLD": "no answer|no reply|no response|unanswered|an answer cannot|answer cannot be|cannot be answered|can not be answered|can t be answered|not be answered|not be answering|stays open|remains open|remain open|left open|undecided|unresolved|unsettled",
        "STAYS": "can|cannot|be|to give|have|has|remain|remains|stay|stays|leave|left|go|goes|possible|available",
        "IGNORES": "do not know|don t know|no idea|not sure|not certain|no knowledge|not aware|no clue|lack the information|lack information|no information",
        "MOVE": "let us|let s|shall we|could we|can we|may we|we should|we could|why don t we|i suggest|i propose|i would suggest",
        "ELSEWHERE": "another topic|another subject|other topics|different topic|different subject|something else|change the subject|change the topic|switch topics|another matter|move on",
        "HANDS": "matter for|question for|issue for|is for|put to|addressed to|directed to|asked of|answered by|referred to|refer to|belongs to|best left to|up to|ask the|ask your",
        "UNIT": "faculty|office|department|programme|program|school|dean|registrar|secretariat|institute|administration|board|committee",
        "BARS": "keep me from|keeps me from|keep us from|prevent me|prevents me|prevent us|prevents us|forbid me|forbids me|forbid us|prohibit me|prohibits me|prohibit us|bar me|bars me|stop me|stops me|am barred from|are barred from|am forbidden|been told not|been told to stay|not let me|not allow me|not allow us|not permit me|allows me|allow me",
        "NOBASIS": "no basis|don t have enough|do not have enough|doesn t have enough|does not have enough|not enough evidence|not enough information|insufficient information|insufficient evidence|no grounds|too little information|not enough to go on",
        "BARE": "no comment|nothing to say|no answer to give|no opinion to offer|nothing to add",
    },
    "fr": {
        "OUGHT": "doit|doivent|devra|devront|faut",
        "SPEAKER": "je|j|me|m|moi|mon|ma|mes|nous|notre|nos|cet assistant|ce service",
        "NOT": "ne|n|pas|aucun|aucune|rien|impossible|incapable|sans|jamais|ni|guere|difficile|interdit|deconseille",
        "DENIED": "ne peux|ne peut|n peut|ne pouvons|ne puis|ne pourrai|ne pourrais|ne pourrons|ne saurais|ne saurait|ne saurions|ne sais|pas en mesure|pas capable|incapable|pas autorise|pas autorisee|pas autorises|pas permis|pas habilite|pas habilitee|pas habilites|pas le droit|pas qualifie|pas competent|pas possible|impossible|ne souhaite|ne souhaitons|ne veux|ne vais pas|pas a meme|pas libre",
        "SELF": "je|j|me|m|moi|mon|ma|mes",
        "HEDGE": "pense|crois|suppose|imagine|estime",
        "TELL": "repond|repondent|reponse|trouve|trouvent|trouver|indication|indications|indique|indiquent|precise|precisent|information|informations|renseigne|renseignent|trace|voit|explique|expliquent|donne|donnent|permet|permettent|affirmer|conclure|traite|traitent|apporte|apportent|parle|parlent|mentionne|mentionnent|element de reponse",
        "ACT": "repondre|reponse|reponses|aider|assister|commenter|commentaire|commentaires|discuter|parler|dire|prononcer|conclure|trancher|traiter|aborder|renseigner|conseiller|avis|juger|confirmer|donner suite|evoquer|informer|opinion|tiree|tirer|information|informations|expliquer|speculer|entrer dans|satisfaire|prendre position|fournir|trouve|trouver|eclairer",
        "GIVES_UP": "decliner|decline|declinons|refuse|refusons|refuser|abstenir|abstiens|abstiendrai|abstenons|abstiendrons|renoncer|renonce|renoncons|prefere ne|preferons ne|prefererais ne|prefererait ne|prefere passer|prefere m|aime mieux ne|aimerais mieux ne|laisse cette question|laisse de cote|dois passer|passe mon tour|evite|eviterai|garder le silence|garde le silence|me taire|me tais|passe sur|me garderai|me garde de|me gardons|passe cette question|reserve mon avis",
        "ASKED": "cette question|cette demande|votre question|votre demande|la question|ce sujet|ce point|ce theme|cela|ceci|ce propos|cet objet|y repondre|en parler|en discuter|la dessus",
        "BEYOND": "hors de|hors|dehors de|au dela de|depasse|sort de|sort du|ne releve pas|ne fait pas partie|ne relevent pas|echappe|n est pas de",
        "DOMAIN": "competence|competences|attributions|mon domaine|notre domaine|mon ressort|perimetre|mes fonctions|mon role|ma mission|mon champ|mes connaissances",
        "SOURCE": "source|sources|document|documents|texte|textes|extrait|extraits|dossier|pieces|fichier|fichiers|passages|element|elements|contexte",
        "LACKS": "muet|muets|muette|muettes|silencieux|silencieuses|ne disent|ne dit|ne contiennent|ne contient|ne mentionnent|ne mentionne|ne precisent|ne precise|ne permet|ne permettent|ne suffisent|ne suffit|insuffisant|insuffisants|insuffisante|insuffisantes|pas assez|ne parlent pas|ne fournissent|ne donnent|n indiquent|ne traitent",
        "UNTOLD": "aucune reponse|pas de reponse|sans reponse|aucun commentaire|reste ouverte|demeure ouverte|pas repondre|pas etre repondu|en suspens|ne pas repondre",
        "STAYS": "peut|reste|restera|rester|demeure|demeurera|laisser|laisse|possible|est|sera",
        "IGNORES": "ne sais pas|ne sait pas|ne savons pas|l ignore|ignore|ignorons|m echappe|m echappent|nous echappe|aucune idee|pas certain|pas sur de|ne connais pas",
        "MOVE": "parlons|passons|changeons|changer|il vaut mieux|mieux vaut|pourrions nous|abordons|evoquons|je propose|je suggere|nous devrions|on devrait|si nous",
        "ELSEWHERE": "autre sujet|autre theme|autre chose|un autre point|de sujet|de theme|d autres sujets",
        "HANDS": "posez|adressez|soumettez|a poser|a adresser|adresser a|adressee a|a soumettre|releve de|releve du|est du ressort|revient a|revient au|appartient a|renvoyer a",
        "UNIT": "faculte|departement|programme|secretariat|scolarite|service|ecole|doyen|administration|institut|jury|bureau",
        "BARS": "m interdisent|m interdit|m est interdit|m est defendu|me vois contraint|nous interdisent|nous interdit|m empechent|m empeche|nous empechent|nous empeche|ne me permettent|ne me permet|ne nous permettent|ne m autorisent|ne m autorise|defendent de",
        "NOBASIS": "pas assez|pas suffisamment|ne dispose pas|elements insuffisants|manque d elements|manque d informations|aucun element|aucune base",
        "BARE": "aucun commentaire|pas de commentaire|rien a dire|rien a ajouter|aucun avis a donner",
    },
    "vi": {
        "OUGHT": "phải|cần",
        "SPEAKER": "tôi|chúng tôi|mình|em|chúng em|của tôi|trợ lý này|hệ thống này",
        "NOT": "không|chưa|chẳng|chả|khó|khó mà|đâu có",
        "DENIED": "không thể|chưa thể|chẳng thể|không được phép|không được quyền|không có quyền|không có thẩm quyền|không đủ thẩm quyền|không có khả năng|không đủ khả năng|không dám|không tiện|không muốn|không nên|xin không|xin phép không|xin được không|không ở vị trí|không ở vào vị trí|không giúp được|không trả lời được|không được trả lời|sẽ không",
        "SELF": "tôi|mình|em",
        "HEDGE": "nghĩ|tin|cho rằng|đoán",
        "TELL": "cho biết|trả lời|câu trả lời|thấy|tìm thấy|cho thấy|chỉ ra|thông tin|nhắc|nêu|nói|giải thích|ghi|đề cập|làm rõ|bàn đến|chứa",
        "ACT": "trả lời|câu trả lời|giúp|hỗ trợ|nhận xét|bàn|bàn đến|bàn về|bình luận|kết luận|giải đáp|phản hồi|tư vấn|nói|nói về|thảo luận|ý kiến|khẳng định|xác nhận|đánh giá thêm|cung cấp|rút ra|đáp ứng|thông tin|giải thích|suy đoán|phát biểu|tìm thấy|đề cập|lên tiếng|đưa ra",
        "GIVES_UP": "từ chối|khước từ|xin miễn|được miễn|miễn bình luận|miễn trả lời|xin kiếu|xin phép không|xin không|xin được không|né tránh|tránh bàn|giữ im lặng|im lặng|chịu thua|bỏ qua|để ngỏ",
        "ASKED": "câu hỏi này|yêu cầu này|đề nghị này|vấn đề này|vấn đề đó|nội dung này|chủ đề này|chủ đề đó|điều này|việc này|việc đó|chuyện này|câu này|được hỏi|nội dung về",
        "BEYOND": "nằm ngoài|ngoài|không thuộc|không nằm trong|vượt quá|vượt ngoài|vượt",
        "DOMAIN": "phạm vi hỗ trợ|phạm vi|thẩm quyền|lĩnh vực|chuyên môn|khả năng|nhiệm vụ|trách nhiệm|quyền hạn|hiểu biết|tầm",
        "SOURCE": "tài liệu|nguồn|văn bản|dữ liệu|đoạn trích|tư liệu|bằng chứng|thông tin hiện có",
        "LACKS": "không nhắc đến|không đề cập|không nói gì|không nói đến|không nói|không chứa|không có thông tin|không nêu|chưa đủ|không đủ|không có tài liệu nào|không có nguồn nào|im lặng|thiếu",
        "UNTOLD": "không có câu trả lời|chưa có câu trả lời|câu trả lời không thể|bỏ ngỏ|để ngỏ|không được trả lời|không có lời giải",
        "STAYS": "không thể|vẫn|sẽ|để|còn|rút ra|yêu cầu|câu hỏi|cho",
        "IGNORES": "không biết|chẳng biết|không rõ|chưa rõ|không nắm|chưa biết|không chắc",
        "MOVE": "xin bạn|mong bạn|bạn hãy|bạn nên|chúng ta|chúng ta nên|chúng ta hãy|ta nên|ta hãy|hãy|ta đổi|ta chuyển|đổi|chuyển sang|mời bạn",
        "ELSEWHERE": "chủ đề khác|điều khác|chuyện khác|đề tài khác|vấn đề khác|đổi đề tài|đổi chủ đề|nội dung khác",
        "HANDS": "xin nhường|xin để|nhường cho|xin hỏi|nên hỏi|nên gửi|hãy hỏi|xin chuyển|gửi đến|dành cho|thuộc về",
        "UNIT": "khoa|phòng|ngành|trường|bộ môn|viện|ban",
        "BARS": "không cho phép tôi|không cho phép chúng tôi|cấm tôi|ngăn tôi|không cho tôi|không để tôi",
        "NOBASIS": "không có căn cứ|chưa đủ căn cứ|không đủ căn cứ|chưa có cơ sở|không có cơ sở|chưa đủ cơ sở|không đủ cơ sở|thiếu căn cứ|thiếu cơ sở|chưa có căn cứ|chưa có đủ thông tin|chưa đủ thông tin|không đủ thông tin|không có đủ thông tin",
        "BARE": "không có gì để nói|miễn bình luận|không bình luận|không có ý kiến",
    },
}

#: A sentence refuses if it holds all classes of one rule. WITHHOLDS is a NOT with an ACT within REACH
#: words after it and a SPEAKER within REACH words of it; UNABLE is DENIED of an ACT that follows
#: within NEAR words: without a speaker it needs the request or the sources as its object; UNSAID
#: is a NOT with a TELL within NEAR words after it. NOT_ME is a SELF with a NOT within REACH words in
#: a sentence that states no fact: no digit, no opinion (HEDGE).
NEAR, REACH = 2, 6
RULES: list[frozenset[str]] = [
    frozenset(r.split())
    for r in (
        "SPEAKER WITHHOLDS", "SOURCE UNSAID", "NOT_ME", "UNABLE ASKED", "UNABLE SOURCE", "SPEAKER GIVES_UP", "GIVES_UP ASKED", "GIVES_UP ACT SPEAKER", "MOVE ELSEWHERE",
        "BEYOND DOMAIN SPEAKER", "BEYOND DOMAIN ASKED", "SOURCE LACKS", "UNTOLD STAYS", "UNTOLD ASKED", "SPEAKER IGNORES", "ASKED HANDS UNIT", "BARS ACT", "NOBASIS ACT", "SPEAKER NOBASIS ACT", "BARE",
    )
]
#: A sentence of at most so many words that only denies an act of answering has no other subject.
CURT = 5


def _bare(text: str) -> str:
    """Words with one blank on either side."""
    return " " + re.sub(r"[\W_]+", " ", text).strip() + " "


def _machine(words: dict[str, str], form):
    import ahocorasick

    a = ahocorasick.Automaton()
    of: dict[str, set[str]] = {}
    for kind, some in words.items():
        for w in some.split("|"):
            of.setdefault(f" {form(w)} ", set()).add(kind)
    for w, kinds in of.items():
        a.add_word(w, (frozenset(kinds), len(w)))
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def machines() -> dict[str, object]:
    """One automaton a language; Vietnamese also without accents, for texts that have none."""
    same = lambda w: w
    return {"en": _machine(GRAMMAR["en"], same), "fr": _machine(GRAMMAR["fr"], same), "vi": _machine(GRAMMAR["vi"], same), "vi bare": _machine(GRAMMAR["vi"], folded)}


def _classes(machine, flat: str) -> set[str]:
    places: dict[str, list[tuple[int, int]]] = {}
    for end, (kinds, length) in machine.iter(flat):
        for k in kinds:
            places.setdefault(k, []).append((end - length + 1, end))
    found = set(places)
    acts = places.get("ACT", [])
    # number of words between the end of one match and the start of another after it
    gap = lambda end, start: 0 if end == start else flat.count(" ", end + 1, start) + 1
    ought = [o[0] for o in places.get("OUGHT", ())]
    leads = lambda a, b, most: a[1] <= b[0] and gap(a[1], b[0]) <= most and not any(a[1] <= o < b[0] for o in ought)
    if any(leads(d, a, NEAR) for d in places.get("DENIED", ()) for a in acts):
        found.add("UNABLE")
    if any(leads(n, t, NEAR) for n in places.get("NOT", ()) for t in places.get("TELL", ())):
        found.add("UNSAID")
    spoken = places.get("SPEAKER", [])
    for n in places.get("NOT", ()) if spoken and acts else ():
        if any(leads(n, a, REACH) for a in acts) and any(gap(min(n[1], p[1]), max(n[0], p[0])) <= REACH for p in spoken):
            found.add("WITHHOLDS")
            break
    if "NOT" in found and "SELF" in found and "HEDGE" not in found and not re.search(r"\d", flat):
        if any(gap(min(n[1], p[1]), max(n[0], p[0])) <= REACH for n in places["NOT"] for p in places["SELF"]):
            found.add("NOT_ME")
    return found


#: What a text must hold for each class that is made of others.
_PARTS = {"WITHHOLDS": {"NOT", "ACT"}, "UNABLE": {"DENIED", "ACT"}, "UNSAID": {"NOT", "TELL"}, "NOT_ME": {"NOT", "SELF"}}
_NEEDS = [frozenset().union(*[_PARTS.get(c, {c}) for c in r]) for r in RULES] + [frozenset({"DENIED", "ACT"})]


def refuses(answer: str) -> bool:
    """Whether a sentence of the answer declines or says that no answer can be given. An empty
    text doesn't; sentences end at full stops, semicolons and line ends."""
    m = machines()
    low, flat = plain(answer).casefold(), folded(answer)
    kinds = [("en", flat), ("fr", flat), ("vi", low), *([("vi bare", flat)] if low.isascii() else [])]
    for name, text in kinds:
        # a language of which the whole text holds no rule's words needs no look at its sentences
        whole = {c for _, (some, _) in m[name].iter(_bare(text)) for c in some}
        if not any(n <= whole for n in _NEEDS):
            continue
        for sentence in re.split(r"(?<=[.!?;])\s+|\n+", text):
            view = _bare(sentence)
            found = _classes(m[name], view)
            if any(r <= found for r in RULES) or ("UNABLE" in found and len(view.split()) <= CURT):
                return True
    return False
