"""Seed sentences per language, written for this package, that start the training of the language models.

They only have to be everyday prose with the common words of each language; the
models are then retrained on sentences of the corpus that the seeds recognise.
"""

SEEDS = {
    "en": """
The people who live in this town have been waiting for the new bridge since last winter. Nobody knows when the work will be
finished, but the mayor said that it should not take more than two years. What do you think about the idea of opening the old
market again? She was not sure whether they would come, because it had been raining all day and the roads were still under water.
There are many ways to learn how to cook, and most of them begin with a simple soup. Which of these books has he already read?
How does the machine work when there is no power? They asked us if we could help them with their things before the end of the
week. I would like to know why this letter was never answered. After the meeting, some of the members stayed to talk with each
other about the price of bread. It is clear that both reports were written by the same person, although the second one looks much
older than the first. Where can you find a good place to sleep between here and the coast? When the children came home, their
mother had made something warm to eat, and all of them sat down at once. The values in the table are shown for every month of the
year, from the highest to the lowest. If you want to change your order, please write to the office that sent it to you.
According to the newspaper, more than half of the houses in the north were sold within a few days. He did not say anything else.
This page shows only a small part of what was kept. Can you compare these two lists and describe what has changed since then?
Without them, it could not be done at all, and those who had to pay for it were not even told about the delay.""",
    "fr": """
Les gens qui vivent dans cette ville attendent le nouveau pont depuis l'hiver dernier. Personne ne sait quand les travaux seront
terminés, mais le maire a dit que cela ne devrait pas durer plus de deux ans. Que pensez-vous de l'idée de rouvrir le vieux
marché ? Elle n'était pas sûre qu'ils viendraient, parce qu'il avait plu toute la journée et que les routes étaient encore sous
l'eau. Il y a plusieurs façons d'apprendre à cuisiner, et la plupart commencent par une soupe toute simple. Lequel de ces livres
a-t-il déjà lu ? Comment la machine fonctionne-t-elle lorsqu'il n'y a pas de courant ? Ils nous ont demandé si nous pouvions les
aider avec leurs affaires avant la fin de la semaine. Je voudrais savoir pourquoi cette lettre n'a jamais reçu de réponse. Après
la réunion, quelques membres sont restés pour parler du prix du pain. Il est clair que les deux rapports ont été écrits par la
même personne, bien que le second semble beaucoup plus ancien que le premier. Où peut-on trouver un bon endroit pour dormir entre
ici et la côte ? Quand les enfants sont rentrés à la maison, leur mère avait préparé quelque chose de chaud, et tous se sont
assis aussitôt. Les valeurs du tableau sont données pour chaque mois de l'année, de la plus haute à la plus basse. Si vous voulez
changer votre commande, écrivez au bureau qui vous l'a envoyée. Selon le journal, plus de la moitié des maisons du nord ont été
vendues en quelques jours. Il n'a rien dit d'autre. Cette page ne montre qu'une petite partie de ce qui a été gardé. Quelles sont
les différences entre ces deux listes, et qu'est-ce qui a changé depuis ? Sans eux, on n'aurait pas pu le faire du tout, et ceux
qui devaient payer n'étaient même pas au courant du retard.""",
    "de": """
Die Leute, die in dieser Stadt leben, warten seit dem letzten Winter auf die neue Brücke. Niemand weiß, wann die Arbeiten fertig
sein werden, aber der Bürgermeister sagte, dass es nicht länger als zwei Jahre dauern sollte. Was halten Sie von der Idee, den
alten Markt wieder zu öffnen? Sie war nicht sicher, ob sie kommen würden, weil es den ganzen Tag geregnet hatte und die Straßen
noch unter Wasser standen. Es gibt viele Wege, das Kochen zu lernen, und die meisten beginnen mit einer einfachen Suppe. Welches
von diesen Büchern hat er schon gelesen? Wie arbeitet die Maschine, wenn es keinen Strom gibt? Sie fragten uns, ob wir ihnen vor
dem Ende der Woche mit ihren Sachen helfen könnten. Ich möchte wissen, warum dieser Brief nie beantwortet wurde. Nach der Sitzung
blieben einige Mitglieder, um miteinander über den Preis des Brotes zu sprechen. Es ist klar, dass beide Berichte von derselben
Person geschrieben wurden, obwohl der zweite viel älter aussieht als der erste. Wo kann man zwischen hier und der Küste einen
guten Platz zum Schlafen finden? Als die Kinder nach Hause kamen, hatte ihre Mutter etwas Warmes gekocht, und alle setzten sich
sofort. Die Werte in der Tabelle sind für jeden Monat des Jahres angegeben, vom höchsten bis zum niedrigsten. Wenn Sie Ihre
Bestellung ändern wollen, schreiben Sie bitte an das Büro, das sie Ihnen geschickt hat. Laut der Zeitung wurde mehr als die
Hälfte der Häuser im Norden innerhalb weniger Tage verkauft. Er hat sonst nichts gesagt. Diese Seite zeigt nur einen kleinen Teil
von dem, was aufbewahrt wurde. Können Sie diese zwei Listen vergleichen und beschreiben, was sich seitdem geändert hat? Ohne sie
hätte man es gar nicht machen können, und diejenigen, die dafür zahlen mussten, wussten nicht einmal von der Verspätung.""",
    "es": """
La gente que vive en esta ciudad espera el nuevo puente desde el invierno pasado. Nadie sabe cuándo estarán terminadas las obras,
pero el alcalde dijo que no deberían durar más de dos años. ¿Qué piensa usted de la idea de volver a abrir el viejo mercado? Ella
no estaba segura de que vinieran, porque había llovido todo el día y los caminos seguían bajo el agua. Hay muchas maneras de
aprender a cocinar, y la mayoría empieza con una sopa sencilla. ¿Cuál de estos libros ha leído ya? ¿Cómo funciona la máquina
cuando no hay corriente? Nos preguntaron si podíamos ayudarles con sus cosas antes del fin de la semana. Quisiera saber por qué
esta carta nunca tuvo respuesta. Después de la reunión, algunos miembros se quedaron para hablar entre ellos del precio del pan.
Está claro que los dos informes fueron escritos por la misma persona, aunque el segundo parece mucho más antiguo que el primero.
¿Dónde se puede encontrar un buen lugar para dormir entre aquí y la costa? Cuando los niños llegaron a casa, su madre había hecho
algo caliente para comer, y todos se sentaron enseguida. Los valores de la tabla se muestran para cada mes del año, del más alto
al más bajo. Si quiere cambiar su pedido, escriba a la oficina que se lo envió. Según el periódico, más de la mitad de las casas
del norte se vendieron en pocos días. No dijo nada más. Esta página muestra solo una pequeña parte de lo que se guardó. ¿Puede
comparar estas dos listas y describir qué ha cambiado desde entonces? Sin ellos no se habría podido hacer, y quienes tenían que
pagarlo ni siquiera sabían del retraso. Lo que hoy tenemos es mejor que lo que había antes, pero todavía falta mucho.""",
    "it": """
La gente che vive in questa città aspetta il nuovo ponte dall'inverno scorso. Nessuno sa quando saranno finiti i lavori, ma il
sindaco ha detto che non dovrebbero durare più di due anni. Che cosa pensa dell'idea di riaprire il vecchio mercato? Lei non era
sicura che sarebbero venuti, perché aveva piovuto tutto il giorno e le strade erano ancora sotto l'acqua. Ci sono molti modi di
imparare a cucinare, e la maggior parte comincia con una zuppa semplice. Quale di questi libri ha già letto? Come funziona la
macchina quando non c'è corrente? Ci hanno chiesto se potevamo aiutarli con le loro cose prima della fine della settimana. Vorrei
sapere perché questa lettera non ha mai avuto risposta. Dopo la riunione alcuni membri sono rimasti per parlare tra loro del
prezzo del pane. È chiaro che le due relazioni sono state scritte dalla stessa persona, anche se la seconda sembra molto più
vecchia della prima. Dove si può trovare un buon posto per dormire tra qui e la costa? Quando i bambini sono tornati a casa, la
madre aveva preparato qualcosa di caldo da mangiare, e tutti si sono seduti subito. I valori della tabella sono indicati per ogni
mese dell'anno, dal più alto al più basso. Se vuole cambiare il suo ordine, scriva all'ufficio che gliel'ha mandato. Secondo il
giornale, più della metà delle case del nord è stata venduta in pochi giorni. Non ha detto altro. Questa pagina mostra solo una
piccola parte di ciò che è stato conservato. Può confrontare questi due elenchi e descrivere che cosa è cambiato da allora? Senza
di loro non si sarebbe potuto fare, e quelli che dovevano pagare non sapevano nemmeno del ritardo. Quello che oggi abbiamo è
meglio di quello che c'era prima, ma manca ancora molto agli altri e alle loro famiglie.""",
    "pt": """
As pessoas que vivem nesta cidade esperam a nova ponte desde o inverno passado. Ninguém sabe quando as obras ficarão prontas, mas
o presidente da câmara disse que não deveriam durar mais de dois anos. O que acha da ideia de voltar a abrir o velho mercado? Ela
não tinha a certeza de que eles viriam, porque tinha chovido o dia todo e as estradas ainda estavam debaixo de água. Há muitas
maneiras de aprender a cozinhar, e a maior parte começa com uma sopa simples. Qual destes livros é que ele já leu? Como funciona
a máquina quando não há corrente? Perguntaram-nos se podíamos ajudá-los com as suas coisas antes do fim da semana. Gostaria de
saber por que razão esta carta nunca teve resposta. Depois da reunião, alguns membros ficaram para falar uns com os outros sobre
o preço do pão. É claro que os dois relatórios foram escritos pela mesma pessoa, embora o segundo pareça muito mais antigo do que
o primeiro. Onde se pode encontrar um bom lugar para dormir entre aqui e a costa? Quando as crianças chegaram a casa, a mãe tinha
feito alguma coisa quente para comer, e todos se sentaram logo. Os valores da tabela são mostrados para cada mês do ano, do mais
alto ao mais baixo. Se quiser mudar a sua encomenda, escreva ao escritório que a enviou. Segundo o jornal, mais de metade das
casas do norte foram vendidas em poucos dias. Não disse mais nada. Esta página mostra apenas uma pequena parte daquilo que foi
guardado. Pode comparar estas duas listas e descrever o que mudou desde então? Sem eles não teria sido possível, e aqueles que
tinham de pagar nem sequer sabiam do atraso. Aquilo que hoje temos é melhor do que o que havia antes, mas ainda falta muito. Quem
são os outros, e quais são as razões pelas quais não foram à nossa casa? Também lhe disseram que não era assim.""",
    "nl": """
De mensen die in deze stad wonen wachten al sinds de vorige winter op de nieuwe brug. Niemand weet wanneer het werk klaar zal
zijn, maar de burgemeester zei dat het niet langer dan twee jaar zou moeten duren. Wat vindt u van het idee om de oude markt weer
te openen? Zij wist niet zeker of ze zouden komen, omdat het de hele dag had geregend en de wegen nog onder water stonden. Er
zijn veel manieren om te leren koken, en de meeste beginnen met een eenvoudige soep. Welke van deze boeken heeft hij al gelezen?
Hoe werkt de machine wanneer er geen stroom is? Ze vroegen ons of wij hen voor het einde van de week met hun spullen konden
helpen. Ik zou graag willen weten waarom deze brief nooit is beantwoord. Na de vergadering bleven enkele leden om met elkaar over
de prijs van het brood te praten. Het is duidelijk dat beide verslagen door dezelfde persoon zijn geschreven, hoewel het tweede
er veel ouder uitziet dan het eerste. Waar kan men tussen hier en de kust een goede plaats vinden om te slapen? Toen de kinderen
thuiskwamen had hun moeder iets warms gemaakt, en ze gingen allemaal meteen zitten. De waarden in de tabel worden voor elke maand
van het jaar gegeven, van de hoogste tot de laagste. Als u uw bestelling wilt wijzigen, schrijf dan naar het kantoor dat haar
heeft gestuurd. Volgens de krant werd meer dan de helft van de huizen in het noorden binnen enkele dagen verkocht. Hij heeft
verder niets gezegd. Deze bladzijde laat slechts een klein deel zien van wat er is bewaard. Kunt u deze twee lijsten vergelijken
en beschrijven wat er sindsdien is veranderd? Zonder hen had het helemaal niet gekund, en degenen die ervoor moesten betalen
wisten niet eens van de vertraging. Wat wij vandaag hebben is beter dan wat er vroeger was, maar er ontbreekt nog veel.""",
}
