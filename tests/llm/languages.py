"""Plain sentences in many languages, invented for the tests."""

SENTENCES = {
    "English": "The small village lay on the bank of the river, and the old naïve baker opened his café before the sun rose over the roofs.",
    "German": "Das kleine Dorf lag am Ufer des Flusses, und der alte Bäcker öffnete sein Geschäft, bevor die Sonne über die Dächer stieg. Überall war es früh.",
    "French": "Le petit village était situé au bord de la rivière, et le vieux boulanger ouvrait déjà sa boutique à l’aube, là où naît le jour. Âgé, il rêvait.",
    "Spanish": "El pequeño pueblo estaba a la orilla del río, y el viejo panadero abría su tienda antes de que saliera el sol. ¿Quién lo vio ayer? ¡Nadie!",
    "Portuguese": "A pequena aldeia ficava à beira do rio, e o velho padeiro abria a loja antes do nascer do sol. Não há ninguém que não o conheça, são irmãos.",
    "Italian": "Il piccolo villaggio era sulla riva del fiume, e il vecchio fornaio apriva già la bottega prima che sorgesse il sole. Così è la città, però più giù.",
    "Catalan": "El petit poble era a la riba del riu, i el vell forner ja obria la botiga abans que sortís el sol. És així, però ningú no ho sabia; col·lecció d’avui.",
    "Dutch": "Het kleine dorp lag aan de oever van de rivier, en de oude bakker opende zijn winkel vóór de zon opkwam. Eén van de coöperaties is geïnteresseerd.",
    "Danish": "Den lille landsby lå ved bredden af floden, og den gamle bager åbnede sin butik, før solen stod op over tagene. Både æbler og øl var på bordet.",
    "Swedish": "Den lilla byn låg vid stranden av ån, och den gamle bagaren öppnade sin butik innan solen gick upp över taken. Även äpplen och öl fanns på bordet.",
    "Norwegian": "Den lille landsbyen lå ved bredden av elven, og den gamle bakeren åpnet butikken før solen steg over takene. Også blåbær og øl sto på bordet.",
    "Icelandic": "Litla þorpið stóð við árbakkann og gamli bakarinn opnaði búðina áður en sólin kom upp yfir þökin. Það var ekki fyrr en síðar að Þórður vissi þetta.",
    "Faroese": "Lítla bygdin lá við áarbakkan, og gamli bakarin læt handilin upp, áðrenn sólin kom undan. Hetta var eitt gott árið í Føroyum, søgdu teir øll.",
    "Finnish": "Pieni kylä sijaitsi joen rannalla, ja vanha leipuri avasi kauppansa ennen kuin aurinko nousi kattojen ylle. Tänään hän söi myöhään, eikä kukaan nähnyt.",
    "Estonian": "Väike küla asus jõe kaldal ja vana pagar avas oma poe enne, kui päike katuste kohale tõusis. Õhtul oli vaikne, kõik läksid koju ja öö oli pime.",
    "Irish": "Bhí an sráidbhaile beag ar bhruach na habhann, agus d’oscail an seanbháicéir a shiopa sular éirigh an ghrian. Ní raibh aon duine ann ó mhaidin.",
    "Welsh": "Roedd y pentref bach ar lan yr afon, ac agorodd yr hen bobydd ei siop cyn i’r haul godi. Mae’r tŷ ar y bryn, a’r dŵr yn oer iawn; gwên fach oedd ganddo.",
    "Basque": "Herri txikia ibaiaren ertzean zegoen, eta okin zaharrak denda irekitzen zuen eguzkia atera baino lehen. Inork ez zekien zer gertatu zen Iruñean.",
    "Polish": "Mała wieś leżała na brzegu rzeki, a stary piekarz otwierał sklep, zanim słońce wzeszło nad dachami. Każdy źrebak ćwiczył już wśród łąk, gdzie żyją jeże.",
    "Czech": "Malá vesnice ležela na břehu řeky a starý pekař otevíral obchod dříve, než slunce vyšlo nad střechy. Příliš žluťoučký kůň úpěl ďábelské ódy.",
    "Slovak": "Malá dedina ležala na brehu rieky a starý pekár otváral obchod skôr, než slnko vyšlo nad strechy. Vŕba, kôň, ľad, dážď a päť ťažkých hláv.",
    "Slovene": "Majhna vas je ležala na bregu reke in stari pek je odprl trgovino, še preden je sonce vzšlo nad strehami. Včasih čaka vsakdo na boljše čase.",
    "Croatian": "Malo selo ležalo je na obali rijeke, a stari pekar otvarao je dućan prije nego što je sunce izašlo. Čovjek šeće, žena uči, đak piše noću.",
    "Hungarian": "A kis falu a folyó partján feküdt, és az öreg pék kinyitotta a boltját, mielőtt a nap felkelt a tetők fölött. Árvíztűrő tükörfúrógép, őszi eső.",
    "Romanian": "Satul mic se afla pe malul râului, iar bătrânul brutar își deschidea prăvălia înainte ca soarele să răsară. Țara întreagă știa și aștepta.",
    "Turkish": "Küçük köy nehrin kıyısındaydı ve yaşlı fırıncı güneş çatıların üzerine doğmadan dükkânını açardı. İğne, çağ, ışık, değil mi? Şimdi gör.",
    "Azerbaijani": "Kiçik kənd çayın sahilində idi və qoca çörəkçi günəş çıxmamış dükanını açardı. Heç kəs bilmirdi ki, bu gün nə olacaq, işıq sönmüşdü.",
    "Turkmen": "Kiçijik oba derýanyň kenarynda ýerleşýärdi, garry çörekçi bolsa gün dogmanka dükanyny açýardy. Hiç kim şu gün näme boljagyny bilmeýärdi.",
    "Albanian": "Fshati i vogël ndodhej në breg të lumit, dhe furrtari plak hapte dyqanin para se të dilte dielli. Askush nuk e dinte çfarë do të ndodhte.",
    "Lithuanian": "Mažas kaimas buvo ant upės kranto, o senas kepėjas atidarydavo parduotuvę prieš saulėtekį. Žąsys, ėriukai ir šuo vaikščiojo įprastu keliu, ūkis gyvas.",
    "Latvian": "Mazais ciems atradās upes krastā, un vecais maiznieks atvēra veikalu, pirms saule uzlēca virs jumtiem. Šķirtas ķermeņa daļas, ģimene, ļoti jauka ņieva.",
    "Maltese": "Ir-raħal żgħir kien ħdejn ix-xmara, u l-furnar xiħ kien jiftaħ il-ħanut qabel titla’ x-xemx. Ħadd ma kien jaf x’ġara f’dik il-ġurnata; iċ-ċavetta ntilfet.",
    "Esperanto": "La malgranda vilaĝo kuŝis ĉe la bordo de la rivero, kaj la maljuna bakisto malfermis sian vendejon antaŭ ol la suno leviĝis. Ĵaŭde neniu sciis tion.",
    "Vietnamese": "Ngôi làng nhỏ nằm bên bờ sông, và người thợ làm bánh già mở cửa hàng trước khi mặt trời mọc. Không ai biết điều gì đã xảy ra vào ngày hôm đó.",
    "Indonesian": "Desa kecil itu terletak di tepi sungai, dan tukang roti tua membuka tokonya sebelum matahari terbit. Tidak ada yang tahu apa yang terjadi hari itu.",
    "Swahili": "Kijiji kidogo kilikuwa kando ya mto, na mwokaji mzee alifungua duka lake kabla ya jua kuchomoza. Hakuna aliyejua kilichotokea siku hiyo.",
    "Yoruba": "Abúlé kékeré náà wà ní etí odò, àgbà oníbúrẹ́dì sì máa ń ṣí ilé ìtajà rẹ̀ kí oòrùn tó yọ. Ẹnikẹ́ni kò mọ ohun tó ṣẹlẹ̀ ní ọjọ́ yẹn.",
    "Hawaiian": "Aia ke kauhale liʻiliʻi ma kapa o ka muliwai, a wehe ka mea palaoa ʻelemakule i kāna hale kūʻai ma mua o ka puka ʻana o ka lā.",
    "Pinyin": "Xiǎo cūnzhuāng zài hé biān, lǎo miànbāoshī zài tàiyáng shēng qǐ zhīqián jiù kāi le diànmén. Nǚ'ér lǜsè de yīfu hěn piàoliang.",
    "Phonetic": "/ðə smɔːl ˈvɪlɪdʒ leɪ ɒn ðə bæŋk əv ðə ˈrɪvə, ən ði əʊld ˈbeɪkər ˈəʊpənd hɪz ʃɒp bɪˈfɔː ðə sʌn rəʊz/ [ŋ] [θ] [ʒ]",
    "Russian": "Маленькая деревня лежала на берегу реки, и старый пекарь открывал свою лавку прежде, чем солнце вставало над крышами. Ещё никто не знал объяснения.",
    "Ukrainian": "Мале село стояло на березі річки, і старий пекар відчиняв крамницю ще до того, як сходило сонце. Київ — столиця України, її населення живе у великому місті. Ґанок, їжак.",
    "Belarusian": "Маленькая вёска стаяла на беразе ракі, і стары пекар адчыняў краму яшчэ да ўзыходу сонца. Ніхто не ведаў, што здарылася ў той дзень, і ўсе спалі.",
    "Bulgarian": "Малкото село лежеше на брега на реката и старият хлебар отваряше дюкяна си, преди слънцето да изгрее. Никой не знаеше какво се е случило през този ден, а градът още спеше.",
    "Serbian": "Мало село лежало је на обали реке, а стари пекар отварао је радњу пре него што је сунце изашло. Њега нико није чуо, љубав џина и ћирилица ђака.",
    "Macedonian": "Малото село лежеше на брегот на реката, а стариот пекар ја отвораше продавницата пред да изгрее сонцето. Ѓорѓи и Ќирил одат кај ѕвездата, љубов.",
    "Kazakh": "Кішкентай ауыл өзеннің жағасында болды, ал кәрі наубайшы күн шықпай тұрып дүкенін ашатын. Ешкім бұл күні не болғанын білмеді, әңгіме ұзақ.",
    "Mongolian": "Жижиг тосгон голын эрэг дээр оршдог байсан бөгөөд хөгшин талхчин нар мандахаас өмнө дэлгүүрээ нээдэг байв. Улаанбаатар хотын хүн ам өсөж байна.",
    "Greek": "Το μικρό χωριό βρισκόταν στην όχθη του ποταμού, και ο γέρος φούρναρης άνοιγε το μαγαζί του πριν βγει ο ήλιος. Άγνωστο πώς έγινε· κανείς δεν ήξερε.",
    "Ancient Greek": "Ἐν ἀρχῇ ἦν ἡ μικρὰ κώμη παρὰ τῷ ποταμῷ, καὶ ὁ γέρων ἀρτοποιὸς ἀνέῳγε τὸ πωλητήριον πρὶν ἀνατεῖλαι τὸν ἥλιον.",
    "Hebrew": "הכפר הקטן שכן על גדת הנהר, והאופה הזקן פתח את חנותו לפני שהשמש זרחה מעל הגגות. איש לא ידע מה קרה באותו היום, וכולם עוד ישנו בבתיהם.",
    "Arabic": "كانت القرية الصغيرة تقع على ضفة النهر، وكان الخباز العجوز يفتح دكانه قبل أن تشرق الشمس فوق السطوح. لم يعرف أحد ما حدث في ذلك اليوم.",
    "Persian": "دهکدهٔ کوچک در کنار رودخانه بود و نانوای پیر پیش از طلوع آفتاب مغازه‌اش را باز می‌کرد. هیچ‌کس نمی‌دانست آن روز چه گذشت، همه خواب بودند.",
    "Hindi": "छोटा गाँव नदी के किनारे बसा था, और बूढ़ा नानबाई सूरज निकलने से पहले अपनी दुकान खोलता था। किसी को पता नहीं था कि उस दिन क्या हुआ, सब लोग सो रहे थे।",
    "Bengali": "ছোট গ্রামটি নদীর তীরে ছিল, আর বুড়ো রুটিওয়ালা সূর্য ওঠার আগেই তার দোকান খুলত। সেদিন কী ঘটেছিল তা কেউ জানত না, সবাই ঘুমিয়ে ছিল।",
    "Tamil": "சிறிய கிராமம் ஆற்றின் கரையில் இருந்தது, வயதான ரொட்டிக்காரர் சூரியன் உதிப்பதற்கு முன்பே தன் கடையைத் திறந்தார். அன்று என்ன நடந்தது என்று யாருக்கும் தெரியாது.",
    "Thai": "หมู่บ้านเล็ก ๆ ตั้งอยู่ริมแม่น้ำ และคนทำขนมปังชราเปิดร้านก่อนพระอาทิตย์ขึ้นเหนือหลังคา ไม่มีใครรู้ว่าเกิดอะไรขึ้นในวันนั้น ทุกคนยังหลับอยู่",
    "Georgian": "პატარა სოფელი მდინარის ნაპირზე იდგა და მოხუცი მცხობელი მზის ამოსვლამდე აღებდა დუქანს. არავინ იცოდა, რა მოხდა იმ დღეს, ყველას ეძინა.",
    "Armenian": "Փոքրիկ գյուղը գետի ափին էր, և ծեր հացթուխը բացում էր խանութը նախքան արևածագը։ Ոչ ոք չգիտեր, թե ինչ էր պատահել այդ օրը, բոլորը քնած էին։",
    "Korean": "작은 마을은 강가에 있었고, 늙은 제빵사는 해가 지붕 위로 뜨기 전에 가게를 열었다. 그날 무슨 일이 있었는지는 아무도 몰랐고, 모두가 아직 자고 있었다.",
    "Japanese": "小さな村は川のほとりにあり、年老いたパン屋は屋根の上に日が昇る前に店を開けた。その日に何が起きたのか、誰も知らなかった。みんなまだ眠っていた。",
    "Chinese": "小村庄坐落在河边，老面包师在太阳升起之前就打开了店门。没有人知道那天发生了什么事，大家都还在睡觉。",
    "Traditional Chinese": "小村莊坐落在河邊，老麵包師傅在太陽升起之前就打開了店門。沒有人知道那天發生了什麼事，大家都還在睡覺，這個們鐘頭很靜。",
    "Mathematics": "∀x∈ℝ: f(x)≥α·β, ∃ε>0 ∧ ∑ₙ aₙ ≤ ∫₀¹ √x dx ≈ ⅔ ± 0.1, x²+y² ≠ π·r²; A⊂B ⇒ ¬B⊂¬A; λ→∞, Δt=5µs, 3×10⁻⁹ m³",
}
