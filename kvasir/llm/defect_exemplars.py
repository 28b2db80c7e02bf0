"""Labelled sentences of answers: refusals, and what is said besides an answer. One a line; ``x`` stands for a product or mark."""

REFUSAL = """
к сожалению я не могу ответить на этот вопрос
к сожалению не могу вам помочь
этот вопрос вне моей компетенции
про изделие x в документах ничего не нашлось
в загруженных документах об этом ничего не сказано
в документах нет такой информации
не располагаю данными чтобы ответить
у меня нет информации по этому вопросу
я всего лишь программа и не даю таких рекомендаций
я всего лишь помощник и не даю таких рекомендаций
я не уполномочен обсуждать эту тему
давайте сменим тему это я не обсуждаю
сведений по вашему вопросу в базе нет
извините с таким запросом помочь не получится
без документа по x ответа дать не могу
без документа по x отвечать не стану
без данных по x отвечать не стану
раздел о марке x мне недоступен поэтому ответить не смогу
ответить с этим не получится это не моя тема
помочь на это не смогу таких сведений мне не передали
подсказать здесь не могу нет нужных данных
ответить здесь не смогу таких сведений мне не передали
увы я не нашёл ответа среди документов
сожалею мне не попалось ответа в базе
простите не вижу ничего подходящего в паспортах
увы мне не попалось ничего подходящего среди документов
ничего не знаю об этом
я вынужден отказаться от ответа
я отказываюсь отвечать на этот вопрос
мне нечего сказать по этой теме
i'm sorry but i can't help with that
unfortunately i'm not able to provide an answer
as a program i am unable to answer this question
the documents i have contain nothing about this
that is outside what i can discuss
i must decline this request
i'm not allowed to advise on this
i'm not allowed to discuss that subject
i have no information on this topic
i don't have any information about this
let us talk about something else i won't go into that
i'd rather not go into this
i will not discuss this
i will not advise on that subject
i will not go into this
sorry i'm unable to comment on it my sources are silent
regrettably i can't assist here my sources are silent
apologies i cannot answer that it is not my field
apologies i'm unable to answer that
nothing about x turned up in my sources
my documents lack anything on x
the archive does not cover x
the base does not cover x
the base do not cover this
the base lacks anything on x
the files say nothing about x
my documents say nothing about this
the files lack anything on your request
without documents on x i cannot answer
i do not know the answer
leider kann ich diese frage nicht beantworten
leider kann ich ihnen dabei nicht helfen
bei diesem anliegen darf ich nicht helfen
dazu liegen mir keine informationen vor
dazu habe ich keine angaben
bedaure das kann ich nicht sagen
bedaure dazu schweigen meine unterlagen
bedaure darauf habe ich keine antwort
tut mir leid darauf habe ich keine antwort
tut mir leid das kann ich nicht sagen
tut mir leid dazu schweigen meine unterlagen
zu x habe ich in den unterlagen nichts gefunden
ohne unterlagen zu x kann ich nichts sagen
darüber darf ich keine auskunft geben
ich möchte dieses thema nicht besprechen
désolé je ne peux pas répondre à cette question
je n'ai aucune information à ce sujet
il m'est impossible de traiter cette demande
navré mes documents n'en parlent pas
navré je ne peux rien dire là-dessus
navré je n'ai pas la réponse
pardon je n'ai pas la réponse
pardon mes documents n'en parlent pas
pardon je ne peux rien dire là-dessus
je n'ai rien trouvé sur x dans mes documents
sans document sur x je ne peux pas répondre
je ne suis pas autorisé à en parler
je préfère ne pas aborder ce sujet
"""

POLITE = """
обратитесь к менеджеру
попробуйте переформулировать вопрос
рекомендую связаться с технической поддержкой по телефону горячей линии
могу подсказать что-нибудь другое
если останутся вопросы обратитесь к менеджеру
обращайтесь
добрый день
здравствуйте
спасибо за вопрос
спасибо за обращение
с уважением служба поддержки x
please contact a manager
try to rephrase your question
our hotline may be able to assist you
is there anything else i can do
for anything else please contact our support
happy to help
hello
good afternoon
thank you for asking
kind regards x support
bitte wenden sie sich an den kundendienst
kann ich sonst noch etwas für sie tun
versuchen sie die frage anders zu stellen
guten tag
vielen dank für ihre frage
gern geschehen
mit freundlichen grüßen ihr team x
veuillez contacter le service client
essayez de reformuler votre question
puis-je vous aider pour autre chose
bonjour
merci pour votre question
à votre service
cordialement le support x
"""

# What an answer that only gives back its question may put before it.
ECHO_WORDS = frozenset(
    """ваш вопрос вы спросили спрашиваете спрашивали вопрос был задан запрос повторяю звучит так question your you asked ask the was is
    ihre frage sie fragen fragten haben gefragt lautet war votre question vous demandez avez demandé était est la on""".split()
)

# The names of the languages in one another, as word beginnings.
LANGUAGE_NAMES = {
    "ru": ("русск", "по-русски", "russian", "russisch", "russe"),
    "en": ("английск", "по-английски", "english", "englisch", "anglais"),
    "de": ("немецк", "по-немецки", "german", "deutsch", "allemand"),
    "fr": ("французск", "по-французски", "french", "französisch", "français", "francais"),
    "es": ("испанск", "spanish", "spanisch", "espagnol"),
    "it": ("итальянск", "italian", "italienisch", "italien"),
}
