"""Phrasings for the refusal grammar: none stands in the test tables."""

REFUSALS = {
    "en": [
        "I'd prefer to stay out of that one.",
        "Apologies, that request will have to go unanswered.",
        "I'm afraid I have nothing to say on this subject.",
        "We're not in a position to advise on that.",
        "Unfortunately, I lack the information needed to respond.",
        "I must refrain from commenting on AB1234.",
        "This question falls outside what I can discuss.",
        "Answering that would go beyond my competence.",
        "My guidelines forbid me to speak about fees.",
        "I have no idea.",
        "I really could not tell you.",
        "No comment.",
        "It is not possible for me to help here.",
        "The material provided gives no information on this, so I cannot determine it.",
        "Nothing in the passages allows me to reach a conclusion.",
        "I will not be answering questions of this kind.",
        "Could we move on to a different subject?",
        "I am not authorised to give an opinion.",
        "I'd sooner not discuss that.",
        "Sorry, but this inquiry cannot be dealt with here; I can't assist.",
        "The evidence is insufficient to answer the question.",
        "That question is best put to the registrar's office.",
        "I don't have enough information to say.",
        "We regret that we are unable to process this question.",
        "This is a subject I choose not to address.",
        "I'm going to pass on that question.",
        "I do not feel able to judge this matter.",
        "The documents say nothing about that course, hence no reply is possible.",
        "An answer cannot be derived from the context.",
        "As a language model, I'm not permitted to respond to this.",
    ],
    "fr": [
        "Je m'abstiendrai sur ce point.",
        "Je m'abstiendrai de tout commentaire.",
        "Désolé, cette demande restera sans réponse.",
        "Je n'ai rien à dire à ce sujet.",
        "Nous ne sommes pas en mesure de vous conseiller.",
        "Je n'ai pas le droit d'en parler.",
        "Je ne saurais me prononcer.",
        "Cela dépasse mes compétences.",
        "Cette question sort de mon domaine.",
        "Mes consignes m'interdisent d'aborder ce thème.",
        "Je n'en ai aucune idée.",
        "Malheureusement, je l'ignore.",
        "Passons à autre chose.",
        "Changeons de sujet, voulez-vous.",
        "Les documents ne disent rien à ce propos.",
        "Les sources fournies ne suffisent pas pour conclure.",
        "Il n'est pas possible de répondre à cette question.",
        "Je préférerais ne pas répondre.",
        "J'aime mieux ne pas en discuter.",
        "Je refuse d'aider à cela.",
        "Je regrette, mais je dois renoncer à répondre.",
        "Cette question relève du secrétariat de la faculté.",
        "Je ne dispose pas d'assez d'éléments pour trancher.",
        "Aucun élément du dossier ne permet de trancher.",
        "Je ne peux malheureusement pas vous renseigner.",
        "Impossible de répondre.",
        "Je ne suis pas habilité à donner un avis.",
        "Aucun commentaire.",
        "On ne peut pas répondre à partir de ces extraits.",
        "Je laisse cette question de côté.",
    ],
    "vi": [
        "Tôi xin được miễn bình luận.",
        "Xin lỗi, yêu cầu này sẽ không được trả lời.",
        "Tôi không có gì để nói về chuyện này.",
        "Chúng tôi không ở vị trí để tư vấn việc đó.",
        "Rất tiếc, tôi chưa có đủ thông tin để phản hồi.",
        "Em không dám nhận xét.",
        "Vấn đề này vượt quá khả năng của tôi.",
        "Câu hỏi này không nằm trong lĩnh vực của chúng tôi.",
        "Quy tắc không cho phép tôi nói về học phí.",
        "Tôi không rõ.",
        "Tôi chẳng biết gì về môn này.",
        "Hãy nói sang chuyện khác nhé.",
        "Ta đổi đề tài đi.",
        "Các văn bản không nói gì về điều này.",
        "Dữ liệu hiện có không đủ để đưa ra câu trả lời.",
        "Không thể trả lời câu hỏi này.",
        "Tôi không muốn bàn đến chủ đề đó.",
        "Tôi xin không trả lời.",
        "Tôi buộc phải khước từ đề nghị này.",
        "Câu hỏi này nên gửi đến phòng đào tạo để được giải đáp.",
        "Tôi thiếu căn cứ để khẳng định.",
        "Không có tài liệu nào đề cập đến nội dung được hỏi.",
        "Tiếc là tôi không giúp được việc này.",
        "Tôi không được quyền đưa ra ý kiến.",
        "Chưa thể đưa ra kết luận từ các đoạn trích.",
        "Xin phép không bình luận.",
        "Toi khong the giup ban viec nay.",
        "Rat tiec, toi khong tra loi duoc cau hoi nay.",
        "Tôi từ chối thảo luận về vấn đề này.",
        "Câu trả lời không thể rút ra từ nguồn đã cho.",
    ],
}

ANSWERS = {
    "en": [
        "A student may decline the offer within ten days.",
        "The application is refused when two documents are missing.",
        "You cannot take the exam twice in one semester.",
        "I can't stress this enough: AB1234 needs 12 credits.",
        "Students who are unable to attend must tell the office.",
        "Yes, the course is outside the core curriculum.",
        "Answer sheets are collected by the invigilator.",
        "The dean cannot change the grade after the deadline.",
        "No, the library does not lend journals.",
        "Questions about fees are answered in room 12.",
        "The maximum is 24 credits.",
        "It is not permitted to enter the laboratory alone.",
        "Please contact the academic office to enrol.",
        "My advice: register before 3 May, otherwise a fee of 20 is due.",
        "The exam has an open question and ten closed ones.",
        "The course covers silent film and sources of early cinema.",
        "Nothing else is needed besides the form.",
        "Only one document is missing.",
        "The committee will discuss the request on Monday.",
        "We offer it in another semester.",
    ],
    "fr": [
        "L'étudiant peut refuser l'offre dans les dix jours.",
        "L'examen ne peut pas être repassé le même jour.",
        "Non, la bibliothèque ne prête pas les revues.",
        "Il est interdit de parler pendant l'épreuve.",
        "Le dossier est refusé si deux pièces manquent.",
        "Rien d'autre n'est exigé.",
        "Les étudiants qui ne peuvent pas venir préviennent le secrétariat.",
        "Le cours compte 6 crédits et ne comporte pas d'examen.",
        "Merci de contacter le secrétariat pour vous inscrire.",
        "Le jury se prononce en juin.",
        "La réponse est oui.",
        "Le sujet de l'examen est remis à 8 heures.",
    ],
    "vi": [
        "Sinh viên có thể từ chối học bổng trong 10 ngày.",
        "Không được thi hai lần trong một học kỳ.",
        "Số tín chỉ tối đa là 24.",
        "Sinh viên không thể dự thi phải báo cho phòng đào tạo.",
        "Không, thư viện không cho mượn tạp chí.",
        "Đơn bị từ chối nếu thiếu hai giấy tờ.",
        "Bạn vui lòng liên hệ phòng đào tạo để đăng ký.",
        "Học phần này không có tiên quyết.",
        "Thông tin được công bố trước ngày 3 tháng 5.",
        "Hội đồng sẽ trả lời đơn trong 7 ngày.",
        "Toi da 24 tin chi moi hoc ky.",
        "Câu hỏi mở chiếm 40 phần trăm bài thi.",
    ],
}

# Written after the grammar, batch by batch; each widened it once its first result was known.
SECOND = [
    "I would ask you to put this to someone else; I cannot judge it.",
    "My apologies, I am not equipped to answer that.",
    "There is not enough in these excerpts to give you a reply.",
    "I'll leave that question to the experts.",
    "We do not comment on individual grades.",
    "That lies beyond what this service offers.",
    "I'm unable to find an answer in the files.",
    "It would be inappropriate for me to respond.",
    "Regrettably I can offer no opinion.",
    "I shall not go into that.",
    "Je regrette de ne pouvoir vous aider.",
    "Il ne m'appartient pas de répondre.",
    "Ce n'est pas à moi de trancher.",
    "Nous nous abstenons de tout avis.",
    "Je n'ai trouvé aucune réponse dans les documents.",
    "Veuillez m'excuser, je ne suis pas autorisée à traiter cette demande.",
    "Le contexte ne permet pas d'y répondre.",
    "Je préfère garder le silence.",
    "Votre demande est hors de mon périmètre.",
    "Je ne dispose d'aucune information à ce sujet.",
    "Tôi không thể đáp ứng yêu cầu này.",
    "Xin thứ lỗi, tôi chưa thể giải đáp thắc mắc của bạn.",
    "Tôi không tìm thấy câu trả lời trong tài liệu.",
    "Việc này không thuộc thẩm quyền của tôi.",
    "Tôi không có thông tin về môn học đó.",
    "Mình chịu, không trả lời được.",
    "Tôi xin giữ im lặng về điểm này.",
    "Không đủ dữ liệu để trả lời.",
    "Rất tiếc, tôi không hỗ trợ nội dung này.",
    "Chúng ta bàn chuyện khác đi.",
]

THIRD = [
    "Commenting on that would not be right for me.",
    "I'm sorry, I have been told to stay quiet about it.",
    "We can't go any further into this.",
    "That question is not mine to answer.",
    "There's no way to tell from the text.",
    "I wish I could help, but no.",
    "Sorry, I must leave your question unanswered.",
    "I am in no position to rule on this.",
    "The excerpts leave the matter undecided.",
    "Please accept that I keep my opinion to myself.",
    "Il m'est interdit d'en dire davantage.",
    "Je me vois contraint de ne pas répondre.",
    "Cela n'entre pas dans mes attributions.",
    "Le texte fourni ne répond pas à la question.",
    "Nous n'avons pas d'avis à donner.",
    "Je vous prie de m'excuser, je passe sur cette question.",
    "On ne trouve aucune indication dans les sources.",
    "Je ne suis malheureusement pas compétente en la matière.",
    "Qu'il me soit permis de ne rien ajouter.",
    "Rien dans le dossier ne me permet d'affirmer quoi que ce soit.",
    "Tôi đành để ngỏ câu hỏi này.",
    "Tôi e rằng mình không giúp gì được.",
    "Trong tài liệu không thấy câu trả lời.",
    "Tôi không tiện nói thêm.",
    "Xin bạn hỏi điều khác.",
    "Nguồn cung cấp không cho biết điều đó.",
    "Tôi không nhận trả lời loại câu hỏi này.",
    "Đây không phải việc tôi được phép bàn.",
    "Tôi chưa đủ hiểu biết để trả lời.",
    "Nội dung đó tôi xin phép bỏ qua.",
]

FOURTH = [
    "Sorry, I can't speak to that.",
    "I'm afraid that information isn't something I have.",
    "I don't feel comfortable giving an opinion.",
    "The question lies outside my area of knowledge.",
    "The documents at hand do not let me answer.",
    "I would advise you to ask the faculty this question instead.",
    "We are sorry, but your question can't be answered at present.",
    "I have not been given any material on that.",
    "There is insufficient evidence for a firm answer.",
    "It's not my place to say.",
    "Désolée, je ne trouve pas la réponse.",
    "Je n'ai pas cette information.",
    "Nous ne pouvons donner suite à votre demande.",
    "Les extraits n'apportent aucun élément de réponse.",
    "Je ne suis pas en droit de commenter cela.",
    "Cette demande dépasse le cadre de ma mission.",
    "Il m'est difficile de répondre.",
    "Posez plutôt cette question au secrétariat.",
    "Je décline toute réponse à ce sujet.",
    "Aucun document ne traite de ce point.",
    "Xin lỗi, mình không trả lời câu này.",
    "Tôi chưa tìm được thông tin phù hợp.",
    "Câu hỏi của bạn vượt ngoài hiểu biết của tôi.",
    "Tài liệu không ghi nội dung bạn hỏi.",
    "Việc này phải hỏi phòng đào tạo, tôi không rõ.",
    "Chúng tôi rất tiếc không thể hỗ trợ.",
    "Tôi không dám chắc.",
    "Yêu cầu này bị từ chối.",
    "Không có căn cứ nào để trả lời.",
    "Hãy hỏi tôi chuyện khác.",
]

FIFTH = [
    "I'm sorry to say I can't be of help here.",
    "My role does not include giving such judgements.",
    "I would rather leave this to your adviser.",
    "No reply can be offered on the basis of the texts supplied.",
    "It is beyond my authority to decide that.",
    "I haven't the faintest idea.",
    "The supplied sources do not help with this.",
    "We must politely refuse.",
    "Sorry, I am barred from discussing grades.",
    "Let's turn to something else.",
    "Je ne suis pas la bonne personne pour répondre.",
    "Malheureusement, je n'ai rien trouvé.",
    "Les textes ne parlent pas de cela.",
    "Je me garderai de tout avis.",
    "Il vaut mieux changer de sujet.",
    "Ma fonction ne me le permet pas.",
    "Je ne veux pas spéculer.",
    "Faute d'éléments, je ne conclus pas.",
    "La réponse m'échappe.",
    "Ce n'est pas de mon ressort.",
    "Tôi không thể bình luận gì thêm.",
    "Xin lỗi bạn, điều này ngoài thẩm quyền của chúng tôi.",
    "Các tài liệu không chứa câu trả lời.",
    "Tôi không có câu trả lời cho bạn.",
    "Tôi không được giao trả lời vấn đề này.",
    "Mình không biết đâu.",
    "Chưa đủ bằng chứng để kết luận.",
    "Tôi đành từ chối.",
    "Câu hỏi này xin nhường cho bộ môn giải đáp.",
    "Tôi mong bạn hỏi nội dung khác.",
]

# Written last and never used to change the grammar.
UNSEEN = [
    "I regret that I cannot provide an answer.",
    "Sorry, but this is not a question I am able to answer.",
    "I must decline to discuss individual students.",
    "The available documents contain no information about that.",
    "We are not authorised to comment.",
    "I don't know the answer to that.",
    "Unfortunately, nothing in the sources addresses this.",
    "It's outside my expertise, I'm afraid.",
    "I'd rather we talked about something else.",
    "My policy does not allow me to answer.",
    "Je ne suis pas en mesure de répondre.",
    "Je préfère ne pas me prononcer là-dessus.",
    "Les documents fournis ne contiennent pas cette information.",
    "Désolé, cela dépasse mes attributions.",
    "Je ne peux pas commenter cette décision.",
    "Aucune des sources ne permet de répondre.",
    "Nous devons décliner votre demande.",
    "Parlons d'autre chose, si vous le voulez bien.",
    "Je n'ai pas assez d'informations pour conclure.",
    "Mes règles m'empêchent d'en dire plus.",
    "Tôi rất tiếc, tôi không thể trả lời.",
    "Tài liệu không có thông tin về vấn đề này.",
    "Xin phép từ chối bình luận.",
    "Nội dung này nằm ngoài phạm vi của tôi.",
    "Chúng tôi không được phép tư vấn việc này.",
    "Tôi chưa có đủ cơ sở để kết luận.",
    "Hãy chuyển sang chủ đề khác.",
    "Tôi không biết câu trả lời.",
    "Không thể xác định từ các nguồn hiện có.",
    "Quy định không cho phép tôi nói thêm.",
]
