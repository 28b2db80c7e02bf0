"""Labelled exemplars of template residue, and of texts that only speak about such things.

One exemplar a line. ``slot`` stands for an unfilled placeholder of any notation, ``num`` for a number. Words of one
meaning stand for one another, see ``MEANINGS``.
"""

# Placeholders: an opening bracket, and what is within: a name, an index, a label in words, or a word that asks.
PLACEHOLDERS = """
{{
${
<%
[[
@@
%(
% name
# name
__ name
$ name
{ name
{ index
[ asks
< asks
< label
"""

# Beginnings of words, and whole words, that ask for something to be filled in or name it.
ASKING = (
    ("встав", "указ", "допис", "заполн", "впиш", "введ", "уточн", "назван", "наимен", "insert", "enter", "fill", "einfüg", "einfug", "eintrag", "ergänz",
     "complét", "complet", "insér", "inser", "rempli", "défin", "defin", "confirm", "ersetz", "remplac"),
    frozenset("дата значение here your tbd todo tba hier name wert datum valeur nom ici".split()),
)

_WORDS = {
    "page": "страниц раздел документ каталог карточк вкладк файл сайт адрес содержим контент page section document catalogue catalog file content site seite datei "
    "dokument katalog inhalt abschnitt fichier contenu rubrique",
    "js": "javascript js скрипт сценари script scripts scripting skript skripte",
    "on": "включит активир разреш enable enabling ennable activat allow aktivier activez activer",
    "load": "загруз откр показ отобраз работае load display show open fetch run work geladen geöffnet angezeigt anzuzeigen charger afficher ouvrir fonctionne",
    "fail": "удалос failed unable could cannot konnte konnten impossible",
    "without": "без without ohne sans",
    "not": "не not nicht ne pas doesn't don't can't won't couldn't",
    "gone": "удален удалена перенесен перенесена gone removed deleted moved",
    "exist": "существует exist exists existe existiert",
    "request": "запрос операци",
    "refused": "отклонен выполняется завершил выполнен",
    "pending": "заполнен готовится уточняется наполняется",
    "replace": "замените перепишите replace overwrite ersetzen remplacez",
    "prose": "текст абзац рассказ",
    "subject": "издели компани серию",
    "filltext": "mustertext blindtext beispieltext platzhaltertext",
}
#: Meanings of words by their beginnings.
MEANINGS = {w: meaning for meaning, words in _WORDS.items() for w in words.split()}

RESIDUE = {
    "placeholder": """
slot
""",
    "filler": """
здесь будет описание товара
здесь будет текст про изделие
тут будет абзац про изделие не забыть поменять
здесь разместим текст про серию
описание раздела пока не заполнено
контент страницы пока не заполнен
описание появится в ближайшее время
содержание карточки товара готовится
текст карточки товара уточняется
контент страницы уточняется
описание карточки товара уточняется
раздел наполняется зайдите позже
раздел в разработке
страница находится в разработке
страница в стадии наполнения
информация скоро появится
бла бла бла потом напишем нормально
это текст рыба замените его перед публикацией
текст рыба текст рыба
замените этот текст своим
замените этот абзац своим текстом
введите текст здесь
вставьте сюда описание
напишите здесь что-нибудь про изделие
тестовый текст тестовый текст тестовый текст
текст абзаца текст абзаца текст абзаца
подзаголовок раздела подзаголовок раздела
заголовок раздела текст абзаца
образец текста образец текста
пример текста пример текста
йцукен йцукен фыва пролд
фыва фыва пролдж
asdf asdf qwerty test test
qwerty qwerty asdf
test test test test
xxx xxx xxx xxx
body text body text body text
sample text sample text sample text
dummy text dummy text
placeholder text placeholder text
heading goes here body text
your headline goes here
your product story goes here
your text goes here
the product story goes here
product description goes here
description goes here
insert text here
enter text here
type something about the product in this block
write something about the product here
replace this paragraph with your own words
overwrite this block with the final copy
replace this text with your own
this is dummy text without meaning
section coming soon
content coming soon
description coming soon
text to be added
content to be added
description will be added later
content pending do not publish
content still missing do not publish
copy still missing do not publish
text missing do not publish
page under construction
inhalt folgt in kürze
text folgt in kürze
beschreibung folgt in kürze
hier steht später die produktbeschreibung
hier entsteht ein text über das produkt
hier kommt noch ein text hin
mustertext mustertext mustertext
blindtext blindtext blindtext
beispieltext beispieltext beispieltext
dies ist ein blindtext ohne bedeutung
platzhaltertext bitte ersetzen
diesen absatz bitte vor der veröffentlichung ersetzen
bitte text einfügen
contenu bientôt disponible
description bientôt disponible
la description sera ajoutée ici
le texte sera ajouté ici
ici viendra le texte du produit
insérez votre texte ici
texte à compléter avant publication
remplacez ce paragraphe par votre texte
texte d'exemple texte d'exemple
faux texte faux texte
ceci est un faux texte
page en construction
seite im aufbau
текст page товара пока не pending
описание page пока не pending
page товара в разработке
описание товара в разработке
описание page в разработке
page пока не pending
page товара pending
описание page pending
содержание page pending
text folgt
beschreibung folgt
replace этот текст
replace this text
heading num heading num body text
page à définir
здесь будет prose про subject
здесь должен быть prose про subject
здесь разместим prose про subject
тут будет prose про subject
тут должен быть prose про subject
тут разместим prose про subject
в этом блоке будет prose про subject
в этом блоке должен быть prose про subject
в этом блоке разместим prose про subject
не забыть поменять
copy still missing
body still missing
body to follow do not publish
copy to follow do not publish
copy to follow
body to follow
prose page pending
prose page товара pending
бла бла бла
fill in this block with your own words
""",
    "error": """
ошибка num
ошибка num страница не найдена
num страница не найдена
страница не найдена
запрашиваемая страница не найдена
запрошенная страница не существует
такой страницы не существует
жаль такого раздела больше нет
возможно она была удалена или перенесена
этот документ больше не существует
файл не найден или повреждён код
не удалось открыть документ
не удалось загрузить страницу
не удалось загрузить файл
не удалось показать раздел
не удалось получить данные с сервера
не удалось установить соединение с базой данных
ошибка подключения к базе данных
внутренняя ошибка сервера
сервер временно недоступен
сервис временно недоступен
сайт временно недоступен
ведутся технические работы
повторите запрос позже
повторите попытку позже
попробуйте обновить страницу
обратитесь к администратору сайта
ой что-то пошло не так
произошла непредвиденная ошибка
содержимое страницы не может быть показано
доступ к запрошенному документу ограничен
доступ запрещён недостаточно прав
нет прав на просмотр страницы
у вас нет прав для просмотра этой страницы
войдите в личный кабинет
сессия истекла обновите страницу и войдите заново
слишком много запросов с вашего адреса
подтвердите что вы не робот
операция завершилась с ошибкой num превышен лимит
операция отклонена сервером нет прав
запрос отклонён сервером
запрос не выполняется нет прав
запрос завершился с ошибкой num
превышено время ожидания ответа сервера
не удалось открыть страницу истекло время ожидания
жаль такого адреса не существует
соединение сброшено сервером
query failed table doesn't exist in srv app lib db php on line num
warning undefined variable in php on line num
проверка браузера
internal server error
bad gateway
num bad gateway
service unavailable
service temporarily unavailable
service temporarily unavailable please try again in num minutes
gateway timeout
num not found
num forbidden
error num page not found
page not found
the page you are looking for could not be found
the file you are looking for has moved
what you requested no longer exists
what you are looking for no longer exists
the requested url was not found on this server
access denied
you do not have permission to view this page
you don't have permission to access this resource
please log in to continue
your session has expired please log in again
your connection was rate limited
too many requests
just a moment checking your browser
checking your browser before accessing
verify you are human
something went wrong while loading this document
uh-oh something went wrong
oops something went wrong
could not load the document code num
could not display this page timeout
could not open the file
failed to display the file code num
failed to load the page
unable to fetch the file connection reset by peer
unable to load the page
content cannot be displayed
an unexpected error occurred please try again later
error establishing a database connection
upstream timed out while reading response header request
upstream prematurely closed connection while reading response header request
traceback most recent call last
typeerror cannot read properties of undefined reading
referenceerror is not defined
nullpointerexception exception in thread main
fatal error uncaught exception
keyerror title
file app py line num in render
at object render app dist main js num num
fehler num die angeforderte seite existiert nicht
fehler num seite nicht gefunden
seite nicht gefunden
seite konnte nicht gefunden werden
datei konnte nicht gefunden werden code num
datei konnte nicht geöffnet werden code num
dokument konnte nicht geladen werden
seite konnte nicht geladen werden
interner serverfehler
der dienst ist vorübergehend nicht erreichbar
die seite ist vorübergehend nicht verfügbar
zugriff verweigert bitte melden sie sich an
zugriff verweigert
zu viele anfragen
etwas ist schiefgelaufen
bitte versuchen sie es später erneut
ihre sitzung ist abgelaufen
erreur num page introuvable
page introuvable
la page demandée n'existe pas
la page demandée est introuvable
impossible de charger le fichier
impossible d'afficher la page
impossible d'ouvrir le document
erreur interne du serveur référence
service momentanément indisponible réessayez plus tard
accès refusé veuillez vous connecter
accès refusé
trop de requêtes
une erreur est survenue
votre session a expiré
не fail load page
не fail load page код num
не fail load данные
не fail load данные код num
fail not load this page
fail to load the page
fail to load this page code num
fail de load le page
fail not load the page contact the page administrator
page fail not load
page fail not load werden
такого page больше нет
такого page больше не exist
такого page у нас нет
увы такого page больше нет
увы такого page не exist
жаль такого page у нас нет
page больше не exist
page больше не доступен
page не найден или повреждён
page не найден
запрошенный page gone
то что вы запросили gone
the page you are looking for is gone
the page you are looking for was gone
the page you are looking for has been gone
what you requested is gone
what you requested was gone
what you are looking for is gone
what you are looking for was gone
what you are looking for has gone
the page no longer exist
was sie suchen existiert not mehr
das gesuchte page existiert not mehr
ce que vous cherchez n'existe plus
la page demandée n'existe plus
request не refused превышен лимит
request refused сервером превышен лимит
request не refused
request refused сервером
request refused с ошибкой num
request не refused истекло время ожидания
contact the page administrator
the page you requested was gone
the page you requested is gone
the page you requested has gone
the page you requested no longer exist
""",
    "scripts": """
включите javascript в браузере
включите javascript в браузере иначе не получится открыть содержимое
включите поддержку js в браузере иначе не получится загрузить каталог
активируйте скрипты в браузере чтобы открыть содержимое
разрешите javascript в браузере
пожалуйста разрешите выполнение сценариев и перезагрузите страницу
в вашем браузере отключены скрипты
в вашем браузере отключён javascript
ваш браузер не поддерживает js каталог недоступен
ваш браузер не поддерживает javascript
для работы сайта необходимо включить javascript в настройках браузера
для просмотра страницы включите javascript
просмотр документа не загрузится без скриптов
каталог не работает без javascript
страница не работает без js
сайт не работает без скриптов
страница не открывается без javascript
javascript is disabled in your browser
please enable javascript to view this page
you need to enable javascript to run this app
enable js to continue
enable javascript and cookies to continue
turn on javascript in your browser settings to see this catalogue
turn on scripts to load this catalogue
switch on scripts in your browser settings before you can open the content
activate scripts in your browser to open the content
allow scripts in your browser to continue
this site requires scripts and cookies turn them on and reload
this site requires javascript
this viewer will not load without javascript
this viewer cannot run without scripts
the catalogue does not work without javascript
the catalogue cannot run without client-side scripting
our site will not load without client-side scripting
your browser does not support javascript
bitte aktivieren sie javascript um diese seite anzuzeigen
aktivieren sie javascript in ihrem browser
ohne aktivierte skripte kann der inhalt nicht dargestellt werden
diese seite benötigt javascript
javascript ist in ihrem browser deaktiviert
ihr browser unterstützt kein javascript
ohne javascript wird der katalog nicht geladen
veuillez activer javascript pour afficher cette page
activez javascript dans votre navigateur
activez les scripts dans votre navigateur pour ouvrir le contenu
javascript est désactivé dans votre navigateur
ce site nécessite javascript
le catalogue ne fonctionne pas sans javascript
votre navigateur ne prend pas en charge javascript
page не load без js
page not load without js
this page will not load without js
our page does not load without js
page funktioniert not without js
page not load without client-side js
without js load page not
on js
on js в браузере
on js чтобы load page
on js to load page
on поддержку js
on поддержку js в браузере чтобы load page
on js иначе не получится load page
on поддержку js иначе не получится load page
turn on js to load this page
turn on js in your browser to load this page
switch on js before you can load the page
bitte on sie js um this page load
veuillez on js pour load cette page
js отключены в браузере
page требует js
page requires js
on js before you can load the page
turn on js before you can load the page
without js fail the page not load
js sont désactivés le page ne peut pas load
""",
}

# The words of the usual Latin filler.
LATIN_FILLER = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in
reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt
culpa qui officia deserunt mollit anim id est laborum
"""

# Sentences that speak about placeholders, messages or scripts of devices and programs.
LEGIT = """
код ошибки num на дисплее контроллера означает обрыв датчика обратной линии а код num замыкание
ошибка num контроллера означает обрыв датчика
если на дисплее горит надпись перезапустите контроллер
если на дисплее появилась ошибка num вызовите мастера
шлюз диспетчеризации при потере связи выдаёт и повторяет опрос через num мин
сервер диспетчеризации при потере связи пишет в журнал и переходит на резерв через num мин
если страница паспорта утеряна копию выдаёт сервисный центр
онлайн-расчёт открывается в браузере с включённым javascript сам паспорт доступен и без него
скрипт опроса на javascript поставляется вместе со шлюзом отключать его не следует
скрипт выгрузки поставляется вместе со шлюзом
посторонним лицам доступ в котельную запрещён ключ хранится у дежурного
временно недоступна окраска корпуса срок поставки белой num недели
раздел монтажа приведён в части num паспорта заполняется у владельца
порядок гарантии приведён в части num паспорта хранится у владельца
в шаблоне письма поле slot подставляет складская программа менять его вручную не нужно
в шаблоне этикетки поле slot заполняет принтер менять его вручную не нужно
регистр slot передаёт температуру бит аварию насоса
лорем название оттенка эмали в палитре
error num on the controller display means an open sensor circuit error num is a blocked pump
if the display shows call the service
if the panel shows restart the controller
the gateway logs when the bus is cut and switches to reserve after num minutes
the online calculator needs javascript in the browser this data sheet can be read without it
the polling script is written in javascript and is preinstalled on the gateway no browser is involved
access to the boiler room is denied to unauthorised persons
permitted diameters mm see note for sample text on the nameplate
the plug is only a placeholder until the meter is fitted
in the letter template the field slot is replaced by the printer with the number
in the invoice template the field slot is replaced by the warehouse program with the number
your description of the fault goes to the claims desk form num
your photo of the fault goes here the claims desk form num
fehler num am regler bedeutet fühlerbruch fehler num eine blockierte pumpe
der online-rechner setzt javascript voraus dieses blatt nicht
das skript der abfrage ist auf dem gateway vorinstalliert
das feld slot der etikettenvorlage füllt der drucker selbst aus
das feld slot der briefvorlage füllt der drucker selbst aus
unbefugten ist der zugriff auf die regelung verweigert
l'erreur num du régulateur signale une sonde coupée
le calculateur en ligne utilise javascript cette notice se lit sans lui
le champ slot du modèle d'étiquette est rempli par l'imprimante
l'accès à la chaufferie est interdit aux personnes non autorisées
"""
