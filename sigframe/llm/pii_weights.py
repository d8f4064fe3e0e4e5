"""Weights of the semi-Markov CRF, written by pii_train."""

WEIGHTS = {
    'address:bias': 0.77,
    'address:capitalised': 1.4,
    'address:de': 0.39,
    'address:de_preposition': -1.4,
    'address:de_two': 2.09,
    'address:en': 0.67,
    'address:es': 2.16,
    'address:fr': 1.86,
    'address:line': 1.29,
    'address:line:': 0.91,
    'address:line:.': 1.21,
    'address:line:other': 0.97,
    'address:n:)': 1.12,
    'address:n:,': 1.58,
    'address:n:.': 1.3,
    'address:n:2=ar': -2.36,
    'address:n:2=c': 1.56,
    'address:n:2=de': -0.79,
    'address:n:2=du': -0.75,
    'address:n:2=en': 1.45,
    'address:n:2=es': 1.08,
    'address:n:2=et': 1.34,
    'address:n:2=ft': 0.52,
    'address:n:2=gt': 0.88,
    'address:n:2=ht': 0.78,
    'address:n:2=ll': -1.17,
    'address:n:2=lt': 1.37,
    'address:n:2=ng': 0.65,
    'address:n:2=rt': 0.64,
    'address:n:2=um': 2.06,
    'address:n:2=zt': 0.45,
    'address:n:cap': -1.16,
    'address:n:class=adv': 0.58,
    'address:n:class=det': 0.7,
    'address:n:class=prep': 1.74,
    'address:n:class=pron': 0.74,
    'address:n:digit': -0.88,
    'address:n:line': 1.8,
    'address:n:word': -1.06,
    'address:n=00': -0.24,
    'address:n=abgeholt': 0.7,
    'address:n=at': 0.39,
    'address:n=bestellt': 0.22,
    'address:n=bestätigt': 0.35,
    'address:n=bezahlt': 0.19,
    'address:n=c': 0.69,
    'address:n=de': -0.59,
    'address:n=du': -0.52,
    'address:n=gemeldet': 0.41,
    'address:n=geprüft': 0.44,
    'address:n=geschrieben': 0.19,
    'address:n=in': 0.66,
    'address:n=la': 1.01,
    'address:n=senden': 1.09,
    'address:n=the': -0.17,
    'address:n=um': 0.93,
    'address:n=unterrichtet': 0.38,
    'address:n=war': -1.55,
    'address:n=übersetzt': 0.52,
    'address:no_capital': -0.77,
    'address:p:,': 1.24,
    'address:p:2=an': 0.39,
    'address:p:2=au': 1.78,
    'address:p:2=ce': 1.22,
    'address:p:2=ch': -0.47,
    'address:p:2=ei': 0.27,
    'address:p:2=en': 1.15,
    'address:p:2=es': 1.03,
    'address:p:2=ic': 0.17,
    'address:p:2=in': 0.2,
    'address:p:2=na': -0.16,
    'address:p:2=ng': 0.3,
    'address:p:2=ni': 0.21,
    'address:p:2=nn': 0.14,
    'address:p:2=od': 0.16,
    'address:p:2=re': -0.37,
    'address:p:2=ro': 1.14,
    'address:p:2=se': 1.13,
    'address:p:2=st': 1.48,
    'address:p:2=te': -1.34,
    'address:p:2=ue': -1.22,
    'address:p:2=ur': -1.18,
    'address:p:2=ve': -1.17,
    'address:p::': 1.35,
    'address:p:class=det': 2.0,
    'address:p:class=prep': 1.68,
    'address:p:line': -0.46,
    'address:p:open(': 1.14,
    'address:p:sign': -0.24,
    'address:p=a': 0.74,
    'address:p=adresse:': 0.96,
    'address:p=alte': -0.99,
    'address:p=an': 1.36,
    'address:p=at': 0.54,
    'address:p=au': 1.17,
    'address:p=büro': 0.73,
    'address:p=en': 1.26,
    'address:p=in': 0.97,
    'address:p=ist': 0.95,
    'address:p=nach': 0.89,
    'address:p=near': 0.91,
    'address:p=neue': -0.54,
    'address:p=office:': 0.84,
    'address:p=sommes': 1.03,
    'address:p=to': 1.2,
    'address:place_ending': 1.88,
    'address:pp=brief an': 0.83,
    'address:pp=das büro': 0.69,
    'address:pp=está en': 1.27,
    'address:pp=go to': 1.02,
    'address:pp=kommt an': 0.95,
    'address:pp=lieferung an': 0.72,
    'address:pp=moved to': 0.81,
    'address:pp=mudamos a': 1.21,
    'address:pp=nous sommes': 1.24,
    'address:pp=on drive': -0.93,
    'address:pp=open at': 0.46,
    'address:pp=our office:': 1.01,
    'address:pp=rendez-vous au': 0.86,
    'address:pp=seen near': 1.41,
    'address:pp=stands at': 1.25,
    'address:pp=steht in': 0.95,
    'address:pp=treffpunkt ist': 1.01,
    'address:pp=unsere adresse:': 0.58,
    'address:pp=wurde an': 1.21,
    'address:pp=zieht nach': 0.74,
    'address:street_lower': 0.2,
    'address>address:.': 0.17,
    'address>address:.\n': -0.14,
    'address>address:_': -0.39,
    'address>address:lines': -0.17,
    'address>address:near': 0.27,
    'address>email:\ncc:': 0.13,
    'address>email:.': 0.28,
    'address>email:cc:': 0.29,
    'address>email:lines': 0.89,
    'address>email:near': 0.38,
    'address>identity:\n': -0.29,
    'address>identity:,': -0.2,
    'address>identity:near': -0.11,
    'address>name:\n': -0.4,
    'address>name:\nA': -0.56,
    'address>name:.': -0.15,
    'address>name:.\n': 0.38,
    'address>name:.\n#': -0.11,
    'address>name:.\n73.': 0.28,
    'address>name:.\nAsk': 0.34,
    'address>name:.\nDer': -0.85,
    'address>name:.\nIn': -0.34,
    'address>name:.\nSee': -0.12,
    'address>name:.\nThe': -0.73,
    'address>name:.\nTo:': 0.31,
    'address>name:.\nTwo': -0.37,
    'address>name:.\nvon': -0.64,
    'address>name:. -- \n': 0.58,
    'address>name:. 34.': 0.14,
    'address>name:. 5': -0.42,
    'address>name:. >': -0.17,
    'address>name:. Der': -0.11,
    'address>name:. Dr': 0.38,
    'address>name:. In': -0.58,
    'address>name:. The': -0.19,
    'address>name:. To:': 0.2,
    'address>name:. Two': -0.61,
    'address>name:. van': -0.53,
    'address>name:Herr': 0.63,
    'address>name:La': -0.18,
    'address>name:cc': 0.25,
    'address>name:du': -0.16,
    'address>name:lines': -0.16,
    'address>name:near': 0.11,
    'address>name:um.': -0.12,
    'address>name:war': -0.35,
    'address>phone:\n': 0.94,
    'address>phone:\nTel.': 0.5,
    'address>phone:\ncall': 0.78,
    'address>phone:\nfax': 0.95,
    'address>phone:\nrow': -0.51,
    'address>phone:\ntel.': 0.7,
    'address>phone:\ntel:': 1.42,
    'address>phone:\ntél.': 0.36,
    'address>phone:,': 1.57,
    'address>phone:, fax': 1.04,
    'address>phone:.': 0.24,
    'address>phone:.\n': 0.16,
    'address>phone:. tel:': 0.11,
    'address>phone:lines': 0.69,
    'address>phone:near': 0.87,
    'address>phone:tel:': 0.35,
    'email:bias': 1.74,
    'email:plain_at': 1.72,
    'email:plain_dot': 1.72,
    'email:spelt_at': 1.7,
    'email:spelt_dot': 1.71,
    'email>address:\n': 0.25,
    'email>address:lines': 0.59,
    'email>address:near': 1.09,
    'email>email:\nMail': 0.15,
    'email>email:.': 0.19,
    'email>email:.\n': 0.54,
    'email>email:. cc:': 0.46,
    'email>email:Mail': 0.16,
    'email>email:lines': 0.87,
    'email>email:near': 0.26,
    'email>identity:\nSSN': 0.28,
    'email>identity:, or': -0.36,
    'email>identity:lines': -0.18,
    'email>identity:or': -0.16,
    'email>name:\n': 0.18,
    'email>name:\n87.': 0.12,
    'email>name:\nIn': -0.39,
    'email>name:-- \n': 0.12,
    'email>name:.': 0.26,
    'email>name:.\n': -0.47,
    'email>name:.\nIn': -0.44,
    'email>name:.\ncc': 0.14,
    'email>name:. ##': -0.49,
    'email>name:. 47.': 0.14,
    'email>name:. 53.': 0.19,
    'email>name:. >': -0.33,
    'email>name:. Ask': 0.14,
    'email>name:. Der': -0.13,
    'email>name:. In': -0.95,
    'email>name:. See': -0.36,
    'email>name:. To:': 0.21,
    'email>name:. Two': -0.17,
    'email>name:. Von': -0.64,
    'email>name:Ask': 0.18,
    'email>name:Dr': 0.18,
    'email>name:Each': -0.12,
    'email>name:La': -0.29,
    'email>name:_': 0.22,
    'email>name:near': 0.44,
    'email>phone:,': 1.72,
    'email>phone:, or': 1.63,
    'email>phone:.': 0.23,
    'email>phone:.\n': 0.14,
    'email>phone:.\ntel:': 0.14,
    'email>phone:. tel:': 0.13,
    'email>phone:_': 0.17,
    'email>phone:near': -0.41,
    'email>phone:or': 2.91,
    'identity:cut': -1.92,
    'identity:id_3_2_4': 2.27,
    'identity:id_8_letter': 2.9,
    'identity:id_code': 1.97,
    'identity:id_digits': -0.85,
    'identity:id_other': -2.56,
    'identity:id_spaced': 2.25,
    'identity:label': 3.4,
    'identity:line': -0.28,
    'identity:line:other': -0.28,
    'identity:n:)': 2.5,
    'identity:n:,': -0.37,
    'identity:n:-': -0.16,
    'identity:n:.': -0.39,
    'identity:n:2=al': 0.15,
    'identity:n:2=ar': 0.22,
    'identity:n:2=cc': 0.45,
    'identity:n:2=ck': -0.18,
    'identity:n:2=ed': -1.95,
    'identity:n:2=el': 0.27,
    'identity:n:2=er': 0.13,
    'identity:n:2=ft': -0.95,
    'identity:n:2=gs': -1.62,
    'identity:n:2=ht': -0.83,
    'identity:n:2=id': -0.92,
    'identity:n:2=is': 0.5,
    'identity:n:2=ld': -1.19,
    'identity:n:2=lo': -0.13,
    'identity:n:2=lt': -0.73,
    'identity:n:2=nd': -0.48,
    'identity:n:2=re': -1.14,
    'identity:n:2=rk': -0.11,
    'identity:n:2=rn': -0.26,
    'identity:n:2=rs': -0.9,
    'identity:n:2=rt': -0.33,
    'identity:n:2=st': -1.34,
    'identity:n:2=te': -0.23,
    'identity:n:2=ts': -0.86,
    'identity:n:2=ur': 0.33,
    'identity:n:2=ve': -0.83,
    'identity:n:2=ws': -0.72,
    'identity:n:2=xt': -0.23,
    'identity:n:[': 0.4,
    'identity:n:cap': 0.93,
    'identity:n:class=adv': 0.52,
    'identity:n:class=conj': -1.76,
    'identity:n:class=prep': 2.37,
    'identity:n:class=pron': -1.11,
    'identity:n:digit': -1.88,
    'identity:n:line': 1.66,
    'identity:n:spaced': 0.35,
    'identity:n:word': -1.18,
    'identity:n=00': -1.78,
    'identity:n=000': -0.35,
    'identity:n=a': 0.57,
    'identity:n=after': -0.34,
    'identity:n=and': -1.23,
    'identity:n=are': -0.92,
    'identity:n=belongs': -1.01,
    'identity:n=checked': -0.65,
    'identity:n=en': 1.34,
    'identity:n=es': -0.82,
    'identity:n=est': -0.46,
    'identity:n=fehlt': -0.42,
    'identity:n=for': 0.63,
    'identity:n=im': 0.53,
    'identity:n=in': 1.18,
    'identity:n=is': 0.44,
    'identity:n=ist': -0.72,
    'identity:n=la': -0.41,
    'identity:n=mentioned': -0.48,
    'identity:n=oder': -0.18,
    'identity:n=or': -0.26,
    'identity:n=por': -0.44,
    'identity:n=rows': -0.42,
    'identity:n=sur': 0.48,
    'identity:n=thanked': -0.76,
    'identity:n=the': -0.7,
    'identity:n=units': -0.52,
    'identity:n=visitors': -0.49,
    'identity:n=waited': -0.65,
    'identity:no_label': -2.05,
    'identity:p:,': -0.55,
    'identity:p:.': 1.27,
    'identity:p:2=ad': 0.49,
    'identity:p:2=ag': -0.36,
    'identity:p:2=al': -0.24,
    'identity:p:2=an': -0.96,
    'identity:p:2=au': -0.51,
    'identity:p:2=ax': -0.47,
    'identity:p:2=bt': -0.13,
    'identity:p:2=ca': 0.89,
    'identity:p:2=ce': -1.77,
    'identity:p:2=ch': -1.28,
    'identity:p:2=ck': -0.95,
    'identity:p:2=ct': -0.53,
    'identity:p:2=de': -1.65,
    'identity:p:2=ed': -0.76,
    'identity:p:2=ei': -0.52,
    'identity:p:2=el': -1.48,
    'identity:p:2=em': -1.21,
    'identity:p:2=en': -1.35,
    'identity:p:2=er': 0.89,
    'identity:p:2=et': -0.98,
    'identity:p:2=ey': -1.34,
    'identity:p:2=ge': -0.36,
    'identity:p:2=hl': -0.76,
    'identity:p:2=ht': -0.88,
    'identity:p:2=hy': -0.26,
    'identity:p:2=id': 1.38,
    'identity:p:2=ie': 1.18,
    'identity:p:2=is': 1.03,
    'identity:p:2=ld': -1.71,
    'identity:p:2=le': -0.66,
    'identity:p:2=ll': -0.55,
    'identity:p:2=na': -1.17,
    'identity:p:2=ne': -0.48,
    'identity:p:2=ng': -1.26,
    'identity:p:2=ni': 1.21,
    'identity:p:2=no': -0.28,
    'identity:p:2=nr': 0.9,
    'identity:p:2=nt': 0.19,
    'identity:p:2=on': -1.28,
    'identity:p:2=or': -0.9,
    'identity:p:2=ow': -0.97,
    'identity:p:2=pt': -1.14,
    'identity:p:2=re': -0.95,
    'identity:p:2=rn': 1.39,
    'identity:p:2=ro': -0.7,
    'identity:p:2=rt': 0.83,
    'identity:p:2=se': -1.44,
    'identity:p:2=sn': 1.38,
    'identity:p:2=ss': 0.54,
    'identity:p:2=te': 1.46,
    'identity:p:2=tt': -0.41,
    'identity:p:2=ty': -0.89,
    'identity:p:2=ur': -0.52,
    'identity:p:2=wn': -0.68,
    'identity:p:2=él': -0.14,
    'identity:p:2=ón': 1.4,
    'identity:p::': 0.57,
    'identity:p:class=adv': 1.28,
    'identity:p:class=conj': -1.82,
    'identity:p:class=det': -0.33,
    'identity:p:class=prep': -0.29,
    'identity:p:line': -0.34,
    'identity:p:sign': 1.76,
    'identity:p:stop': 1.32,
    'identity:p:stop=Tel': -0.28,
    'identity:p:stop=no': 0.92,
    'identity:p:stop=tel': -0.13,
    'identity:p:stop=tél': -0.14,
    'identity:p:word': -0.14,
    'identity:p=afiliación': 0.16,
    'identity:p=al': -0.41,
    'identity:p=and': -0.96,
    'identity:p=are': -0.53,
    'identity:p=article': -1.03,
    'identity:p=artikel': -0.51,
    'identity:p=au': -0.19,
    'identity:p=ausweis-nr.': 0.86,
    'identity:p=ausweisnr.': 0.63,
    'identity:p=batch': -0.68,
    'identity:p=bestellung': -0.24,
    'identity:p=between': -0.5,
    'identity:p=build': -0.61,
    'identity:p=call': -0.35,
    'identity:p=card': 1.02,
    'identity:p=case': -0.49,
    'identity:p=city': -0.73,
    'identity:p=clínica': 0.83,
    'identity:p=code': -0.79,
    'identity:p=counted': -0.54,
    "identity:p=d'identité": 0.45,
    'identity:p=dni': 0.48,
    'identity:p=el': -0.22,
    'identity:p=fax': -0.26,
    'identity:p=file': -0.71,
    'identity:p=gebäude': -0.19,
    'identity:p=id': 0.75,
    'identity:p=id:': 0.55,
    'identity:p=identidad': 1.45,
    'identity:p=invoice': -0.37,
    'identity:p=item': -0.83,
    'identity:p=key': -0.94,
    'identity:p=mobile': -0.25,
    'identity:p=model': -0.91,
    'identity:p=mrn': 1.21,
    'identity:p=máquina': -0.84,
    'identity:p=nie': 0.64,
    'identity:p=no': 0.25,
    'identity:p=number': 0.94,
    'identity:p=nummer': -0.83,
    'identity:p=numéro': -0.45,
    'identity:p=on': -0.17,
    'identity:p=or': -0.26,
    'identity:p=order': -1.31,
    'identity:p=paciente': 0.45,
    'identity:p=parcel': -0.8,
    'identity:p=pasaporte': 0.83,
    'identity:p=passeport': 0.34,
    'identity:p=passport': 1.03,
    'identity:p=patient': 0.72,
    'identity:p=patienten-nr.': 0.25,
    'identity:p=personalausweis': 0.63,
    'identity:p=phone': -0.29,
    'identity:p=picture': -0.59,
    'identity:p=plan': -0.27,
    'identity:p=receipt': -0.55,
    'identity:p=record': -1.5,
    'identity:p=reference': -0.62,
    'identity:p=reisepass': 1.0,
    'identity:p=row': -0.48,
    'identity:p=sample': -0.81,
    'identity:p=serial': -0.88,
    'identity:p=social': 1.49,
    'identity:p=sociale': 1.77,
    'identity:p=sozialversicherungsnummer': 0.76,
    'identity:p=ssn': 0.37,
    'identity:p=steuer-id': 0.16,
    'identity:p=stress': -0.98,
    'identity:p=tel.': -0.21,
    'identity:p=tel:': -0.5,
    'identity:p=telefon': -0.12,
    'identity:p=than': -0.62,
    'identity:p=ticket': -0.68,
    'identity:p=under': -0.3,
    'identity:p=versichertennummer': 0.53,
    'identity:p=versicherungsnummer': 0.91,
    'identity:p=version': -0.68,
    'identity:pp=000000 and': -0.47,
    'identity:pp=0000000 and': -0.5,
    'identity:pp=00000000 and': -0.68,
    'identity:pp=00000000000 and': -0.63,
    'identity:pp=and build': -0.19,
    'identity:pp=and number': -0.54,
    'identity:pp=and receipt': -0.16,
    'identity:pp=ask under': -0.15,
    'identity:pp=carries code': -0.45,
    'identity:pp=carries model': -0.47,
    'identity:pp=carries number': -1.6,
    'identity:pp=carries sample': -0.54,
    'identity:pp=carries serial': -0.7,
    "identity:pp=carte d'identité": 0.29,
    'identity:pp=de afiliación': 0.69,
    'identity:pp=de identidad': 1.45,
    'identity:pp=de paciente': 0.55,
    'identity:pp=de patient': 1.01,
    'identity:pp=der nummer': -0.9,
    'identity:pp=die bestellung': -0.29,
    'identity:pp=est au': -0.11,
    'identity:pp=fehlt reisepass': 0.17,
    'identity:pp=floor number': -0.4,
    'identity:pp=for personalausweis': 0.45,
    'identity:pp=has passport': 0.23,
    'identity:pp=historia clínica': 0.76,
    'identity:pp=id no.': 0.9,
    'identity:pp=id number': 0.35,
    'identity:pp=identity card': 0.97,
    'identity:pp=identity no': 0.9,
    'identity:pp=identity number': 0.8,
    'identity:pp=insurance no.': 0.31,
    'identity:pp=insurance number': 0.47,
    'identity:pp=joignable au': -0.12,
    'identity:pp=karte: ausweisnr.': 0.36,
    'identity:pp=karte: versicherungsnummer': 0.57,
    'identity:pp=la máquina': -0.81,
    'identity:pp=llamarnos al': -0.44,
    'identity:pp=machine numéro': -0.39,
    'identity:pp=more than': -0.43,
    'identity:pp=national id': 0.74,
    'identity:pp=national id:': 0.74,
    "identity:pp=numéro d'identité": 0.46,
    'identity:pp=of order': -1.06,
    'identity:pp=of reference': -0.23,
    'identity:pp=part number': -1.59,
    'identity:pp=passport no.': 0.5,
    'identity:pp=patient id': 0.37,
    'identity:pp=patient number': 2.52,
    'identity:pp=please call': -0.32,
    'identity:pp=security no.': 0.24,
    'identity:pp=security number': 1.02,
    'identity:pp=seguridad social': 1.34,
    'identity:pp=serial number': -1.04,
    'identity:pp=sécurité sociale': 0.73,
    'identity:pp=there are': -0.63,
    'identity:pp=we counted': -0.56,
    'identity:whole': -0.22,
    'identity>address:.': -0.31,
    'identity>address:.\n': 0.59,
    'identity>address:09.\n': -0.5,
    'identity>address:_': -0.11,
    'identity>address:lines': 0.5,
    'identity>email:\n': 0.15,
    'identity>email:\nMail': 0.12,
    'identity>email:.': -0.12,
    'identity>email:. cc:': 0.14,
    'identity>email:_': 0.17,
    'identity>email:lines': 0.36,
    'identity>email:o en': -0.13,
    'identity>email:oder': -0.17,
    'identity>email:or': -0.36,
    'identity>identity:_': -0.41,
    'identity>identity:lines': -0.46,
    'identity>identity:near': 0.24,
    'identity>name:\n': -0.19,
    'identity>name:.': 0.12,
    'identity>name:.\n': 0.25,
    'identity>name:.\nAsk': -0.34,
    'identity>name:.\nIn': -0.45,
    'identity>name:. -- \n': -0.21,
    'identity>name:. 8.': -0.15,
    'identity>name:. Ask': 0.62,
    'identity>name:. Dr': 0.28,
    'identity>name:24': -0.11,
    'identity>name:8925\n': -0.21,
    'identity>name:cc': 0.48,
    'identity>name:near': 0.24,
    'identity>phone:\ntel:': 0.22,
    'identity>phone:\ntél.': 0.18,
    'identity>phone:.': 0.59,
    'identity>phone:. tel:': -0.55,
    'identity>phone:_': 1.54,
    'identity>phone:near': 0.41,
    'identity>phone:tel:': 0.65,
    'name:c=I+proper': 0.66,
    'name:c=I+rare': 0.87,
    'name:c=I+seldom': 0.25,
    'name:c=I+top': -0.37,
    'name:c=known+known': -0.49,
    'name:c=known+proper': -1.25,
    'name:c=known+rare': -0.75,
    'name:c=known+seldom': -0.71,
    'name:c=known+top': -0.46,
    'name:c=proper+known': -0.16,
    'name:c=proper+proper': 0.92,
    'name:c=proper+rare': 1.06,
    'name:c=proper+seldom': 0.78,
    'name:c=proper+top': 0.14,
    'name:c=rare+known': -1.2,
    'name:c=rare+proper': 0.5,
    'name:c=rare+rare': 1.0,
    'name:c=rare+seldom': -0.77,
    'name:c=rare+top': -0.94,
    'name:c=seldom+known': -0.43,
    'name:c=seldom+proper': 1.08,
    'name:c=seldom+rare': 0.33,
    'name:c=seldom+seldom': -0.77,
    'name:c=seldom+top': -1.78,
    'name:c=top+known': -1.38,
    'name:c=top+proper': -0.31,
    'name:c=top+rare': -0.63,
    'name:c=top+seldom': -0.89,
    'name:c=top+top': -1.51,
    'name:f:2=aa': -0.36,
    'name:f:2=ab': -0.33,
    'name:f:2=ad': 0.64,
    'name:f:2=ae': 0.18,
    'name:f:2=af': 0.66,
    'name:f:2=ag': -0.4,
    'name:f:2=ai': 0.11,
    'name:f:2=ak': -0.1,
    'name:f:2=al': -0.81,
    'name:f:2=am': -0.98,
    'name:f:2=an': 0.97,
    'name:f:2=ap': 0.31,
    'name:f:2=ar': -0.57,
    'name:f:2=as': -0.59,
    'name:f:2=au': 0.93,
    'name:f:2=ax': 0.32,
    'name:f:2=ay': -0.71,
    'name:f:2=az': 0.44,
    'name:f:2=bb': -0.11,
    'name:f:2=be': -1.06,
    'name:f:2=bi': -0.47,
    'name:f:2=bo': 0.32,
    'name:f:2=bx': -2.07,
    'name:f:2=bé': -0.84,
    'name:f:2=ca': -1.22,
    'name:f:2=cd': -0.17,
    'name:f:2=ce': -1.37,
    'name:f:2=ch': -0.12,
    'name:f:2=ci': -0.67,
    'name:f:2=cs': -0.73,
    'name:f:2=ct': -0.9,
    'name:f:2=cu': 1.3,
    'name:f:2=cy': -0.37,
    'name:f:2=cé': -0.55,
    'name:f:2=da': -0.55,
    'name:f:2=de': -1.0,
    'name:f:2=di': -0.43,
    'name:f:2=ds': -0.81,
    'name:f:2=dt': 1.02,
    'name:f:2=dy': -0.76,
    'name:f:2=dé': -0.14,
    'name:f:2=ea': 0.5,
    'name:f:2=eb': -0.24,
    'name:f:2=ed': -1.6,
    'name:f:2=ee': -1.0,
    'name:f:2=ef': -0.45,
    'name:f:2=ei': -0.31,
    'name:f:2=ek': -0.27,
    'name:f:2=el': 0.67,
    'name:f:2=ep': -0.81,
    'name:f:2=er': 0.31,
    'name:f:2=es': -1.19,
    'name:f:2=et': -0.82,
    'name:f:2=ey': -1.2,
    'name:f:2=ez': 1.05,
    'name:f:2=fe': 0.11,
    'name:f:2=fo': 0.13,
    'name:f:2=ft': -0.77,
    'name:f:2=fü': 0.35,
    'name:f:2=gb': -0.29,
    'name:f:2=ge': -1.29,
    'name:f:2=gi': 0.63,
    'name:f:2=go': 0.41,
    'name:f:2=gt': -0.61,
    'name:f:2=gu': 0.16,
    'name:f:2=gö': 0.1,
    'name:f:2=gü': 1.03,
    'name:f:2=ha': -0.41,
    'name:f:2=hi': 0.16,
    'name:f:2=hl': -0.97,
    'name:f:2=ho': 0.12,
    'name:f:2=ht': -1.55,
    'name:f:2=hu': -0.32,
    'name:f:2=hy': 1.26,
    'name:f:2=hé': 1.47,
    'name:f:2=hü': -1.18,
    'name:f:2=ia': -1.17,
    'name:f:2=ib': -0.21,
    'name:f:2=ic': 1.54,
    'name:f:2=id': 0.52,
    'name:f:2=ie': -0.12,
    'name:f:2=if': 0.34,
    'name:f:2=ig': 0.62,
    'name:f:2=ii': -0.45,
    'name:f:2=ik': 0.56,
    'name:f:2=im': -0.11,
    'name:f:2=in': 0.21,
    'name:f:2=ip': -0.11,
    'name:f:2=ir': 0.2,
    'name:f:2=is': 1.37,
    'name:f:2=ix': 0.56,
    'name:f:2=iz': 0.22,
    'name:f:2=ja': 0.56,
    'name:f:2=ji': 0.57,
    'name:f:2=jo': 0.42,
    'name:f:2=jö': -0.59,
    'name:f:2=ka': 0.47,
    'name:f:2=kb': -0.11,
    'name:f:2=kd': -0.91,
    'name:f:2=ki': -0.35,
    'name:f:2=ko': 0.16,
    'name:f:2=kt': -0.57,
    'name:f:2=ku': -0.1,
    'name:f:2=ky': 1.11,
    'name:f:2=kz': -1.64,
    'name:f:2=kö': -0.24,
    'name:f:2=kü': -0.38,
    'name:f:2=ld': -0.64,
    'name:f:2=le': -1.15,
    'name:f:2=li': 0.76,
    'name:f:2=ll': 0.29,
    'name:f:2=lo': 0.29,
    'name:f:2=lr': -0.1,
    'name:f:2=ls': -0.45,
    'name:f:2=lt': -1.32,
    'name:f:2=lu': -0.42,
    'name:f:2=ly': -0.89,
    'name:f:2=lz': -0.31,
    'name:f:2=lö': 0.26,
    'name:f:2=lü': -0.65,
    'name:f:2=ma': -0.66,
    'name:f:2=me': -1.53,
    'name:f:2=mo': -0.13,
    'name:f:2=ms': -0.9,
    'name:f:2=mt': -0.15,
    'name:f:2=na': -0.66,
    'name:f:2=nd': 0.35,
    'name:f:2=ne': -0.64,
    'name:f:2=ng': -0.16,
    'name:f:2=ni': 0.63,
    'name:f:2=nk': -0.31,
    'name:f:2=nn': 0.71,
    'name:f:2=no': -0.34,
    'name:f:2=nr': -1.96,
    'name:f:2=ns': 0.21,
    'name:f:2=nt': -1.34,
    'name:f:2=nu': 0.34,
    'name:f:2=né': -0.21,
    'name:f:2=nü': -0.34,
    'name:f:2=ob': 0.86,
    'name:f:2=od': 0.41,
    'name:f:2=og': -0.14,
    'name:f:2=ol': 0.24,
    'name:f:2=on': 0.39,
    'name:f:2=oo': 0.31,
    'name:f:2=op': 0.27,
    'name:f:2=os': -0.6,
    'name:f:2=ot': 1.05,
    'name:f:2=ox': 2.1,
    'name:f:2=oy': -0.12,
    'name:f:2=oz': 0.66,
    'name:f:2=pa': -0.76,
    'name:f:2=pe': 0.19,
    'name:f:2=pi': 0.55,
    'name:f:2=px': -1.08,
    'name:f:2=pz': -0.15,
    'name:f:2=pü': 0.46,
    'name:f:2=ra': 0.2,
    'name:f:2=rb': -0.21,
    'name:f:2=rd': 0.24,
    'name:f:2=re': -0.47,
    'name:f:2=ri': -0.2,
    'name:f:2=rk': -0.14,
    'name:f:2=rn': -0.43,
    'name:f:2=ro': 0.67,
    'name:f:2=rr': -0.12,
    'name:f:2=rs': -0.25,
    'name:f:2=rt': -0.42,
    'name:f:2=ru': -0.4,
    'name:f:2=ry': -1.0,
    'name:f:2=rz': -0.91,
    'name:f:2=ré': -0.71,
    'name:f:2=rö': 0.35,
    'name:f:2=rü': -0.36,
    'name:f:2=sa': -0.28,
    'name:f:2=se': -1.64,
    'name:f:2=sh': -1.15,
    'name:f:2=si': 0.17,
    'name:f:2=ss': -0.1,
    'name:f:2=ta': -0.44,
    'name:f:2=te': -1.34,
    'name:f:2=th': 1.44,
    'name:f:2=ti': -0.66,
    'name:f:2=to': 1.39,
    'name:f:2=ts': -0.86,
    'name:f:2=tt': -0.31,
    'name:f:2=tu': 0.52,
    'name:f:2=ty': -1.38,
    'name:f:2=tz': -0.29,
    'name:f:2=tü': 0.35,
    'name:f:2=ua': 0.16,
    'name:f:2=ub': 0.16,
    'name:f:2=ud': -0.56,
    'name:f:2=ue': -0.65,
    'name:f:2=uf': 0.74,
    'name:f:2=ug': -0.21,
    'name:f:2=uk': 0.26,
    'name:f:2=ul': -0.9,
    'name:f:2=um': 0.41,
    'name:f:2=un': 0.85,
    'name:f:2=uo': 0.48,
    'name:f:2=up': 0.34,
    'name:f:2=ur': 0.78,
    'name:f:2=ut': -0.13,
    'name:f:2=va': -0.27,
    'name:f:2=ve': -0.62,
    'name:f:2=vo': 0.91,
    'name:f:2=vx': -1.26,
    'name:f:2=vz': -0.6,
    'name:f:2=we': -0.19,
    'name:f:2=wi': -0.14,
    'name:f:2=wn': 1.25,
    'name:f:2=wo': 1.06,
    'name:f:2=xd': -0.13,
    'name:f:2=xr': -0.22,
    'name:f:2=xt': -0.2,
    'name:f:2=xz': -0.25,
    'name:f:2=ya': -0.61,
    'name:f:2=ye': -0.54,
    'name:f:2=yi': -0.53,
    'name:f:2=yo': 0.24,
    'name:f:2=za': 0.13,
    'name:f:2=zb': -0.29,
    'name:f:2=zi': 0.89,
    'name:f:2=zo': 0.3,
    'name:f:2=zt': -0.75,
    'name:f:2=ße': -1.85,
    'name:f:2=éb': 0.37,
    'name:f:2=éd': -0.68,
    'name:f:2=ée': -0.77,
    'name:f:2=éf': 0.45,
    'name:f:2=ég': 0.67,
    'name:f:2=ék': 0.28,
    'name:f:2=él': -0.68,
    'name:f:2=ém': -0.14,
    'name:f:2=ép': -0.32,
    'name:f:2=és': 0.17,
    'name:f:2=éx': 0.14,
    'name:f:2=éz': 0.34,
    'name:f:2=öd': 0.14,
    'name:f:2=öf': -0.41,
    'name:f:2=ög': 0.16,
    'name:f:2=ök': 0.4,
    'name:f:2=öl': -0.13,
    'name:f:2=öm': 0.2,
    'name:f:2=ön': 0.32,
    'name:f:2=öp': -0.11,
    'name:f:2=ör': 0.44,
    'name:f:2=öt': 0.86,
    'name:f:2=öz': 0.26,
    'name:f:2=ún': -0.12,
    'name:f:2=üb': 0.86,
    'name:f:2=üd': -0.14,
    'name:f:2=üf': 0.44,
    'name:f:2=üg': 0.1,
    'name:f:2=ük': -0.16,
    'name:f:2=üm': 0.35,
    'name:f:2=üp': 0.36,
    'name:f:2=ür': -0.63,
    'name:f:2=üs': 0.4,
    'name:f:2=üt': 1.1,
    'name:f:2=üx': 0.33,
    'name:f:2=üz': 0.17,
    'name:f:3=ab': -0.38,
    'name:f:3=abe': -1.06,
    'name:f:3=ace': -0.17,
    'name:f:3=ack': -0.61,
    'name:f:3=ada': -0.28,
    'name:f:3=aeb': -0.16,
    'name:f:3=aed': -0.16,
    'name:f:3=aeg': 0.51,
    'name:f:3=aek': 0.17,
    'name:f:3=ael': 0.28,
    'name:f:3=aem': 0.46,
    'name:f:3=aen': 0.43,
    'name:f:3=aer': -0.66,
    'name:f:3=aex': -0.29,
    'name:f:3=aez': 0.19,
    'name:f:3=age': -1.16,
    'name:f:3=ahl': -0.97,
    'name:f:3=aib': -0.39,
    'name:f:3=aic': 0.89,
    'name:f:3=aid': -0.25,
    'name:f:3=aif': -0.25,
    'name:f:3=aik': -0.11,
    'name:f:3=aim': 0.75,
    'name:f:3=ain': -0.19,
    'name:f:3=aip': -0.84,
    'name:f:3=air': 0.21,
    'name:f:3=ais': -0.96,
    'name:f:3=ait': 0.92,
    'name:f:3=aka': 1.58,
    'name:f:3=ake': -0.28,
    'name:f:3=ald': -0.14,
    'name:f:3=ame': -0.35,
    'name:f:3=and': 0.46,
    'name:f:3=ang': 2.08,
    'name:f:3=ank': 0.59,
    'name:f:3=ann': 0.96,
    'name:f:3=ans': 1.59,
    'name:f:3=aot': 0.1,
    'name:f:3=ar': -0.28,
    'name:f:3=are': -0.15,
    'name:f:3=ark': 0.43,
    'name:f:3=arl': 0.1,
    'name:f:3=arn': 0.99,
    'name:f:3=ars': -0.26,
    'name:f:3=art': 0.47,
    'name:f:3=arz': -0.43,
    'name:f:3=ass': -0.59,
    'name:f:3=ast': -0.19,
    'name:f:3=ate': -0.35,
    'name:f:3=atz': 0.1,
    'name:f:3=aud': 0.28,
    'name:f:3=auf': -0.52,
    'name:f:3=aug': 0.45,
    'name:f:3=auk': 0.19,
    'name:f:3=aum': 0.37,
    'name:f:3=aun': 1.01,
    'name:f:3=aur': 2.84,
    'name:f:3=aus': 0.38,
    'name:f:3=aut': -0.31,
    'name:f:3=aux': 0.18,
    'name:f:3=auz': -0.44,
    'name:f:3=aße': -0.25,
    'name:f:3=bai': 0.35,
    'name:f:3=bb': -0.11,
    'name:f:3=bbx': -0.39,
    'name:f:3=bel': 0.37,
    'name:f:3=ben': -0.17,
    'name:f:3=ber': -1.06,
    'name:f:3=bes': -0.49,
    'name:f:3=bic': 0.25,
    'name:f:3=bkd': -0.19,
    'name:f:3=bkz': -0.19,
    'name:f:3=ble': -1.58,
    'name:f:3=bli': -0.25,
    'name:f:3=blo': 0.39,
    'name:f:3=blt': -0.35,
    'name:f:3=bot': -0.46,
    'name:f:3=bpx': -0.16,
    'name:f:3=bra': -0.36,
    'name:f:3=bre': 0.17,
    'name:f:3=bri': -0.44,
    'name:f:3=bru': 0.25,
    'name:f:3=bré': -0.78,
    'name:f:3=cbx': -0.43,
    'name:f:3=cd': -0.17,
    'name:f:3=cei': 0.11,
    'name:f:3=ces': -0.21,
    'name:f:3=cha': -0.18,
    'name:f:3=chi': -0.64,
    'name:f:3=cho': 0.31,
    'name:f:3=cht': -1.38,
    'name:f:3=chu': -0.25,
    'name:f:3=ché': 0.62,
    'name:f:3=chö': -0.23,
    'name:f:3=chü': -0.94,
    'name:f:3=cla': 0.21,
    'name:f:3=cle': 1.15,
    'name:f:3=cpx': -0.47,
    'name:f:3=da': -0.37,
    'name:f:3=dad': 1.59,
    'name:f:3=dai': 1.09,
    'name:f:3=dar': -0.97,
    'name:f:3=day': -0.6,
    'name:f:3=ded': -0.39,
    'name:f:3=dei': 0.63,
    'name:f:3=del': 0.43,
    'name:f:3=den': -1.51,
    'name:f:3=der': -0.6,
    'name:f:3=det': -0.56,
    'name:f:3=dez': 0.11,
    'name:f:3=dge': -0.37,
    'name:f:3=dic': 0.4,
    'name:f:3=dle': -1.12,
    'name:f:3=dni': -0.83,
    'name:f:3=dot': 0.7,
    'name:f:3=dra': 0.69,
    'name:f:3=dre': 0.59,
    'name:f:3=dri': -0.65,
    'name:f:3=dru': 0.53,
    'name:f:3=dré': -0.42,
    'name:f:3=drö': 0.12,
    'name:f:3=drü': -0.62,
    'name:f:3=dt': -0.29,
    'name:f:3=eab': 0.1,
    'name:f:3=ead': -0.76,
    'name:f:3=eag': 0.66,
    'name:f:3=eak': -0.28,
    'name:f:3=eal': -0.21,
    'name:f:3=eam': -0.95,
    'name:f:3=ean': -0.29,
    'name:f:3=eap': 0.77,
    'name:f:3=ear': 0.14,
    'name:f:3=eau': 1.63,
    'name:f:3=eaz': -0.38,
    'name:f:3=ech': -0.5,
    'name:f:3=eck': 0.58,
    'name:f:3=ect': -0.67,
    'name:f:3=eel': 0.74,
    'name:f:3=een': -1.37,
    'name:f:3=eet': -0.26,
    'name:f:3=eez': 0.82,
    'name:f:3=eib': 0.13,
    'name:f:3=eic': 0.72,
    'name:f:3=eid': 0.92,
    'name:f:3=eif': -0.43,
    'name:f:3=eig': 0.41,
    'name:f:3=ein': 0.62,
    'name:f:3=eir': -0.32,
    'name:f:3=eis': -1.32,
    'name:f:3=eit': -0.3,
    'name:f:3=eix': 0.12,
    'name:f:3=eld': -0.54,
    'name:f:3=ell': 1.13,
    'name:f:3=ena': -0.86,
    'name:f:3=end': 0.44,
    'name:f:3=eng': 0.22,
    'name:f:3=enk': -0.8,
    'name:f:3=enn': -0.59,
    'name:f:3=ens': -0.53,
    'name:f:3=ent': -0.84,
    'name:f:3=eot': 0.44,
    'name:f:3=era': -0.25,
    'name:f:3=erd': -0.43,
    'name:f:3=erl': -0.15,
    'name:f:3=ern': -1.0,
    'name:f:3=ero': 2.42,
    'name:f:3=err': -0.12,
    'name:f:3=ert': -0.57,
    'name:f:3=esh': -0.49,
    'name:f:3=ess': -0.73,
    'name:f:3=est': -0.31,
    'name:f:3=ett': -0.18,
    'name:f:3=ety': -0.9,
    'name:f:3=etz': 0.58,
    'name:f:3=eug': -1.15,
    'name:f:3=fae': 0.37,
    'name:f:3=fee': -0.55,
    'name:f:3=fei': -0.32,
    'name:f:3=fel': 0.51,
    'name:f:3=fez': 0.22,
    'name:f:3=fic': 0.69,
    'name:f:3=fle': 0.12,
    'name:f:3=fli': -0.12,
    'name:f:3=flo': 0.43,
    'name:f:3=flt': -0.38,
    'name:f:3=flu': 0.29,
    'name:f:3=flö': -0.22,
    'name:f:3=foo': 0.37,
    'name:f:3=fot': 0.61,
    'name:f:3=fou': -0.23,
    'name:f:3=fox': 2.43,
    'name:f:3=fre': -0.88,
    'name:f:3=fri': 0.45,
    'name:f:3=fro': -0.38,
    'name:f:3=fré': -0.25,
    'name:f:3=gai': 0.34,
    'name:f:3=gau': 0.15,
    'name:f:3=gb': -0.29,
    'name:f:3=gei': -0.36,
    'name:f:3=gel': 0.89,
    'name:f:3=get': -1.26,
    'name:f:3=gez': 0.53,
    'name:f:3=ght': -1.13,
    'name:f:3=gic': 0.32,
    'name:f:3=gkz': -0.83,
    'name:f:3=glo': -0.23,
    'name:f:3=glt': -0.14,
    'name:f:3=gné': -0.16,
    'name:f:3=got': 0.44,
    'name:f:3=gpx': -0.12,
    'name:f:3=gri': 0.73,
    'name:f:3=gro': -0.17,
    'name:f:3=gru': -0.67,
    'name:f:3=grz': -0.12,
    'name:f:3=gré': -0.16,
    'name:f:3=grö': -0.35,
    'name:f:3=gún': -0.12,
    'name:f:3=hae': -0.18,
    'name:f:3=hai': 0.3,
    'name:f:3=hau': -0.73,
    'name:f:3=hea': -1.02,
    'name:f:3=hei': -0.48,
    'name:f:3=hel': 0.58,
    'name:f:3=hen': -1.31,
    'name:f:3=hep': -0.31,
    'name:f:3=her': 1.62,
    'name:f:3=hes': 0.44,
    'name:f:3=het': 0.11,
    'name:f:3=hic': 0.47,
    'name:f:3=hie': 0.18,
    'name:f:3=hio': 0.49,
    'name:f:3=hip': 0.33,
    'name:f:3=hiz': -0.44,
    'name:f:3=hlt': -0.71,
    'name:f:3=hof': 0.29,
    'name:f:3=hok': -0.51,
    'name:f:3=hoo': -0.63,
    'name:f:3=hot': 0.32,
    'name:f:3=hük': -0.35,
    'name:f:3=ian': -0.88,
    'name:f:3=ica': -0.63,
    'name:f:3=ice': -0.88,
    'name:f:3=ich': 0.45,
    'name:f:3=ick': 0.33,
    'name:f:3=id': -0.42,
    'name:f:3=ido': -0.51,
    'name:f:3=idt': 1.09,
    'name:f:3=ieb': -0.46,
    'name:f:3=iek': -0.35,
    'name:f:3=iel': 0.79,
    'name:f:3=iem': -0.26,
    'name:f:3=iep': 0.33,
    'name:f:3=ier': -0.4,
    'name:f:3=iex': 0.15,
    'name:f:3=iez': 0.78,
    'name:f:3=igt': -0.61,
    'name:f:3=ii': -0.45,
    'name:f:3=iic': 0.71,
    'name:f:3=ili': 1.73,
    'name:f:3=ill': -0.78,
    'name:f:3=ima': -0.52,
    'name:f:3=ina': -0.23,
    'name:f:3=ind': 0.73,
    'name:f:3=ine': -0.35,
    'name:f:3=ing': -0.87,
    'name:f:3=ini': 1.04,
    'name:f:3=ink': 0.17,
    'name:f:3=inn': -0.3,
    'name:f:3=iod': -0.4,
    'name:f:3=iof': 0.15,
    'name:f:3=iok': 0.15,
    'name:f:3=iol': 1.13,
    'name:f:3=ion': -1.41,
    'name:f:3=ior': -0.11,
    'name:f:3=iot': 0.33,
    'name:f:3=iox': -0.57,
    'name:f:3=ioz': -0.61,
    'name:f:3=irk': 0.26,
    'name:f:3=irl': -0.25,
    'name:f:3=irn': 0.46,
    'name:f:3=irs': -0.15,
    'name:f:3=irt': 0.7,
    'name:f:3=iss': 0.39,
    'name:f:3=ite': -1.36,
    'name:f:3=ith': 2.58,
    'name:f:3=itt': -1.07,
    'name:f:3=ity': -0.81,
    'name:f:3=ive': -0.36,
    'name:f:3=jei': 0.36,
    'name:f:3=ka': -0.13,
    'name:f:3=kae': 0.32,
    'name:f:3=kai': -0.45,
    'name:f:3=kb': -0.11,
    'name:f:3=kbx': -0.35,
    'name:f:3=kei': 0.16,
    'name:f:3=kel': 0.44,
    'name:f:3=ker': 1.96,
    'name:f:3=kez': 0.36,
    'name:f:3=kic': 0.71,
    'name:f:3=kie': 0.42,
    'name:f:3=kin': -0.76,
    'name:f:3=kio': -0.57,
    'name:f:3=kli': -0.57,
    'name:f:3=klo': -0.23,
    'name:f:3=klé': 0.57,
    'name:f:3=kna': 0.52,
    'name:f:3=knu': 0.44,
    'name:f:3=knü': -0.58,
    'name:f:3=kot': 0.28,
    'name:f:3=kpx': -0.19,
    'name:f:3=kra': 0.13,
    'name:f:3=kre': -0.34,
    'name:f:3=kri': -0.27,
    'name:f:3=kro': 0.38,
    'name:f:3=kt': -0.3,
    'name:f:3=kwo': 1.18,
    'name:f:3=lae': 0.59,
    'name:f:3=lai': -0.4,
    'name:f:3=lal': 0.14,
    'name:f:3=lan': -0.37,
    'name:f:3=lau': -0.13,
    'name:f:3=lea': 0.48,
    'name:f:3=leb': 1.04,
    'name:f:3=led': -0.11,
    'name:f:3=lei': 0.12,
    'name:f:3=lel': 0.56,
    'name:f:3=ler': 0.62,
    'name:f:3=les': -1.23,
    'name:f:3=lex': 0.13,
    'name:f:3=ley': -1.09,
    'name:f:3=lez': 0.82,
    'name:f:3=lic': 0.11,
    'name:f:3=lid': 0.15,
    'name:f:3=lie': 0.13,
    'name:f:3=lim': -0.11,
    'name:f:3=lin': -0.27,
    'name:f:3=lio': -0.49,
    'name:f:3=liz': 0.32,
    'name:f:3=lle': -1.37,
    'name:f:3=llo': 0.26,
    'name:f:3=llt': -0.53,
    'name:f:3=lme': -0.53,
    'name:f:3=lom': -0.11,
    'name:f:3=lon': -0.48,
    'name:f:3=loo': -0.64,
    'name:f:3=lop': -0.2,
    'name:f:3=los': -0.78,
    'name:f:3=lot': 0.63,
    'name:f:3=lou': 0.73,
    'name:f:3=loz': 0.35,
    'name:f:3=lr': -0.1,
    'name:f:3=lrz': -0.17,
    'name:f:3=lth': -1.45,
    'name:f:3=lus': 0.46,
    'name:f:3=lz': -0.28,
    'name:f:3=lés': 0.16,
    'name:f:3=löz': 0.31,
    'name:f:3=lüf': 0.34,
    'name:f:3=lüt': 0.73,
    'name:f:3=ma': -0.47,
    'name:f:3=mas': -0.45,
    'name:f:3=mbx': -0.27,
    'name:f:3=mea': 1.05,
    'name:f:3=mer': -1.5,
    'name:f:3=mie': 0.15,
    'name:f:3=mio': 0.3,
    'name:f:3=mkd': -0.12,
    'name:f:3=mkz': -0.12,
    'name:f:3=mpx': -0.31,
    'name:f:3=mée': -0.76,
    'name:f:3=nae': 0.57,
    'name:f:3=nal': -0.91,
    'name:f:3=nat': -1.36,
    'name:f:3=nau': -0.12,
    'name:f:3=nce': -0.35,
    'name:f:3=nde': -0.76,
    'name:f:3=nds': -0.81,
    'name:f:3=ndé': -0.18,
    'name:f:3=nea': 0.42,
    'name:f:3=ned': -0.36,
    'name:f:3=nei': 0.33,
    'name:f:3=nel': 0.44,
    'name:f:3=nen': 2.21,
    'name:f:3=ner': -2.01,
    'name:f:3=nez': 1.22,
    'name:f:3=nic': 0.43,
    'name:f:3=nie': 0.58,
    'name:f:3=nis': 0.18,
    'name:f:3=nit': -0.26,
    'name:f:3=noo': 0.2,
    'name:f:3=not': 0.58,
    'name:f:3=nou': 0.21,
    'name:f:3=nr': -1.33,
    'name:f:3=nts': -0.8,
    'name:f:3=nus': 0.2,
    'name:f:3=oad': -1.52,
    'name:f:3=och': 0.59,
    'name:f:3=ock': -0.49,
    'name:f:3=ody': -0.71,
    'name:f:3=oel': 0.87,
    'name:f:3=oez': 0.63,
    'name:f:3=oic': 0.91,
    'name:f:3=ois': 2.63,
    'name:f:3=ola': -0.98,
    'name:f:3=oll': 0.11,
    'name:f:3=olt': -0.44,
    'name:f:3=ond': -0.25,
    'name:f:3=one': -0.38,
    'name:f:3=onk': 0.42,
    'name:f:3=onn': 0.52,
    'name:f:3=ono': -1.15,
    'name:f:3=ons': -0.96,
    'name:f:3=oob': 0.33,
    'name:f:3=ood': 0.52,
    'name:f:3=oof': -0.73,
    'name:f:3=oog': 0.21,
    'name:f:3=ook': -0.29,
    'name:f:3=ool': -1.53,
    'name:f:3=oom': 0.16,
    'name:f:3=oon': 0.44,
    'name:f:3=oop': 0.43,
    'name:f:3=oor': -0.11,
    'name:f:3=oos': 0.32,
    'name:f:3=oot': 0.37,
    'name:f:3=oox': -0.5,
    'name:f:3=ooz': 0.46,
    'name:f:3=ord': 0.78,
    'name:f:3=ork': -0.42,
    'name:f:3=orl': 0.54,
    'name:f:3=ors': 0.24,
    'name:f:3=ort': -0.47,
    'name:f:3=ory': -1.12,
    'name:f:3=oss': 0.24,
    'name:f:3=ost': 0.68,
    'name:f:3=oto': 1.73,
    'name:f:3=ott': 0.57,
    'name:f:3=otz': -0.45,
    'name:f:3=oub': -0.12,
    'name:f:3=oud': -0.74,
    'name:f:3=ouk': -0.43,
    'name:f:3=oul': -0.45,
    'name:f:3=oun': -0.21,
    'name:f:3=our': -1.47,
    'name:f:3=ous': -0.92,
    'name:f:3=out': 0.2,
    'name:f:3=oux': -0.53,
    'name:f:3=ouz': 0.15,
    'name:f:3=own': 1.25,
    'name:f:3=pai': -0.67,
    'name:f:3=pbx': -0.45,
    'name:f:3=per': -1.33,
    'name:f:3=phy': 1.26,
    'name:f:3=pic': 0.34,
    'name:f:3=pio': -0.29,
    'name:f:3=pla': 0.72,
    'name:f:3=ple': -0.42,
    'name:f:3=pli': 0.12,
    'name:f:3=plo': 0.27,
    'name:f:3=plö': 0.17,
    'name:f:3=poo': -0.16,
    'name:f:3=pri': 0.6,
    'name:f:3=pté': -0.21,
    'name:f:3=pz': -0.15,
    'name:f:3=qua': 0.16,
    'name:f:3=que': -0.59,
    'name:f:3=quo': 0.49,
    'name:f:3=ra': -0.55,
    'name:f:3=rae': -0.18,
    'name:f:3=raf': 0.64,
    'name:f:3=rag': -0.78,
    'name:f:3=rai': -0.51,
    'name:f:3=ral': -0.15,
    'name:f:3=ran': -0.23,
    'name:f:3=rap': -0.12,
    'name:f:3=ras': 0.69,
    'name:f:3=rat': 0.48,
    'name:f:3=rau': -1.06,
    'name:f:3=raz': -0.15,
    'name:f:3=rbx': -0.47,
    'name:f:3=rd': -0.14,
    'name:f:3=rea': -0.13,
    'name:f:3=red': -0.67,
    'name:f:3=ree': -0.7,
    'name:f:3=ref': 0.16,
    'name:f:3=rei': 0.89,
    'name:f:3=rek': -0.72,
    'name:f:3=ren': -0.54,
    'name:f:3=ret': -0.53,
    'name:f:3=rez': -1.0,
    'name:f:3=ria': -0.19,
    'name:f:3=rib': -0.28,
    'name:f:3=rif': 0.77,
    'name:f:3=rik': -0.1,
    'name:f:3=rim': -0.68,
    'name:f:3=rin': -0.31,
    'name:f:3=rio': 0.15,
    'name:f:3=ris': 0.35,
    'name:f:3=rix': -0.28,
    'name:f:3=rkd': -0.19,
    'name:f:3=rkz': -0.19,
    'name:f:3=rlt': -0.49,
    'name:f:3=rmé': -0.17,
    'name:f:3=rne': -0.46,
    'name:f:3=rof': 0.56,
    'name:f:3=rog': -0.12,
    'name:f:3=rok': 0.45,
    'name:f:3=roo': 0.78,
    'name:f:3=rot': 0.12,
    'name:f:3=rou': -0.35,
    'name:f:3=rox': -0.55,
    'name:f:3=rpx': -0.3,
    'name:f:3=rrn': -0.14,
    'name:f:3=rry': -0.3,
    'name:f:3=rse': -0.63,
    'name:f:3=rte': -0.68,
    'name:f:3=rub': 0.2,
    'name:f:3=sa': -0.2,
    'name:f:3=sae': -0.39,
    'name:f:3=sbx': -0.68,
    'name:f:3=sch': -0.57,
    'name:f:3=scu': 1.3,
    'name:f:3=sei': 0.77,
    'name:f:3=sel': -1.88,
    'name:f:3=sez': 1.02,
    'name:f:3=shi': 0.21,
    'name:f:3=sic': 0.47,
    'name:f:3=ska': -0.78,
    'name:f:3=sky': 1.49,
    'name:f:3=sla': 1.1,
    'name:f:3=sle': 0.31,
    'name:f:3=sli': 0.28,
    'name:f:3=slu': -0.59,
    'name:f:3=sne': 0.26,
    'name:f:3=sni': 0.6,
    'name:f:3=snr': -1.44,
    'name:f:3=sné': 0.74,
    'name:f:3=son': 1.85,
    'name:f:3=sot': 0.4,
    'name:f:3=sra': -0.74,
    'name:f:3=sse': -1.45,
    'name:f:3=ste': 0.37,
    'name:f:3=sto': -0.21,
    'name:f:3=sts': -0.44,
    'name:f:3=ta': -0.42,
    'name:f:3=tae': 0.28,
    'name:f:3=tag': -1.68,
    'name:f:3=tal': -0.29,
    'name:f:3=tau': 0.11,
    'name:f:3=taz': 0.67,
    'name:f:3=tbx': -1.02,
    'name:f:3=tea': 0.14,
    'name:f:3=ted': -1.19,
    'name:f:3=tei': -1.27,
    'name:f:3=tel': 1.16,
    'name:f:3=ten': -0.56,
    'name:f:3=ter': -1.76,
    'name:f:3=tes': -1.08,
    'name:f:3=tet': -0.72,
    'name:f:3=tez': -0.3,
    'name:f:3=tha': -0.42,
    'name:f:3=the': -0.12,
    'name:f:3=thö': 0.12,
    'name:f:3=tia': -0.27,
    'name:f:3=tic': 0.35,
    'name:f:3=tie': 0.2,
    'name:f:3=tkz': -0.84,
    'name:f:3=ton': -1.08,
    'name:f:3=tor': -0.37,
    'name:f:3=tot': 0.38,
    'name:f:3=tou': 0.16,
    'name:f:3=tpx': -0.36,
    'name:f:3=tra': 0.58,
    'name:f:3=tre': 0.17,
    'name:f:3=tri': -0.12,
    'name:f:3=tro': 0.65,
    'name:f:3=tru': -0.58,
    'name:f:3=trz': -0.13,
    'name:f:3=tré': -0.43,
    'name:f:3=trü': 0.22,
    'name:f:3=tte': -0.63,
    'name:f:3=tur': -1.74,
    'name:f:3=tus': 0.19,
    'name:f:3=tvx': -0.1,
    'name:f:3=two': -0.58,
    'name:f:3=tzt': -0.75,
    'name:f:3=tél': -0.68,
    'name:f:3=tür': -0.44,
    'name:f:3=uai': 0.51,
    'name:f:3=uch': 0.31,
    'name:f:3=uck': 0.75,
    'name:f:3=uda': -0.19,
    'name:f:3=ude': -1.16,
    'name:f:3=uel': 0.67,
    'name:f:3=uez': -0.22,
    'name:f:3=uge': -0.77,
    'name:f:3=uic': 0.5,
    'name:f:3=uin': -0.4,
    'name:f:3=uit': -0.95,
    'name:f:3=ull': -0.5,
    'name:f:3=und': 0.13,
    'name:f:3=ung': -1.63,
    'name:f:3=unk': 0.54,
    'name:f:3=unn': -0.51,
    'name:f:3=unt': -1.07,
    'name:f:3=uot': 0.37,
    'name:f:3=uou': 0.36,
    'name:f:3=ure': -0.69,
    'name:f:3=urk': -0.57,
    'name:f:3=url': -0.27,
    'name:f:3=urn': 0.68,
    'name:f:3=urs': 0.43,
    'name:f:3=urt': -0.19,
    'name:f:3=use': -0.83,
    'name:f:3=utt': 0.94,
    'name:f:3=va': -0.12,
    'name:f:3=van': -0.42,
    'name:f:3=ver': -0.53,
    'name:f:3=vid': 0.38,
    'name:f:3=vie': -0.56,
    'name:f:3=vrz': -0.25,
    'name:f:3=vré': -0.15,
    'name:f:3=vz': -0.6,
    'name:f:3=way': -0.16,
    'name:f:3=we': -0.1,
    'name:f:3=weg': -0.26,
    'name:f:3=wei': 0.37,
    'name:f:3=wha': -0.13,
    'name:f:3=whi': 0.55,
    'name:f:3=whö': 0.15,
    'name:f:3=xam': -0.37,
    'name:f:3=xbx': -0.26,
    'name:f:3=xd': -0.13,
    'name:f:3=xel': 0.7,
    'name:f:3=xez': 0.29,
    'name:f:3=xr': -0.22,
    'name:f:3=xz': -0.25,
    'name:f:3=yan': 1.79,
    'name:f:3=yau': -0.12,
    'name:f:3=yei': 0.58,
    'name:f:3=yio': 0.18,
    'name:f:3=zai': 0.27,
    'name:f:3=zb': -0.29,
    'name:f:3=zea': -0.4,
    'name:f:3=zel': 0.42,
    'name:f:3=zez': 0.53,
    'name:f:3=zic': 0.36,
    'name:f:3=zie': -0.48,
    'name:f:3=zkd': -0.32,
    'name:f:3=zkz': -0.56,
    'name:f:3=zlt': -0.21,
    'name:f:3=zou': -0.18,
    'name:f:3=zvx': -0.17,
    'name:f:3=éch': -0.32,
    'name:f:3=éck': 0.76,
    'name:f:3=éel': 0.57,
    'name:f:3=éez': 0.18,
    'name:f:3=éic': 0.3,
    'name:f:3=éll': 0.16,
    'name:f:3=éng': 0.32,
    'name:f:3=énk': 0.22,
    'name:f:3=érl': -0.44,
    'name:f:3=érn': -0.14,
    'name:f:3=érs': -0.69,
    'name:f:3=ért': -0.55,
    'name:f:3=éss': 0.5,
    'name:f:3=étz': 0.14,
    'name:f:3=ído': -0.11,
    'name:f:3=öch': 0.74,
    'name:f:3=öck': -0.34,
    'name:f:3=önd': 0.36,
    'name:f:3=önk': 0.12,
    'name:f:3=örk': -0.31,
    'name:f:3=örn': -0.12,
    'name:f:3=örs': -0.12,
    'name:f:3=öss': 1.01,
    'name:f:3=öst': -0.5,
    'name:f:3=ött': 0.21,
    'name:f:3=ötz': -0.19,
    'name:f:3=üch': 0.14,
    'name:f:3=üel': 0.51,
    'name:f:3=üft': -0.64,
    'name:f:3=üic': 0.49,
    'name:f:3=üll': -0.75,
    'name:f:3=ünd': 0.51,
    'name:f:3=üng': 0.54,
    'name:f:3=ünk': -0.96,
    'name:f:3=ünn': -0.15,
    'name:f:3=ürd': 1.07,
    'name:f:3=ürk': -0.18,
    'name:f:3=ürl': 0.34,
    'name:f:3=ürn': -0.55,
    'name:f:3=üro': -1.63,
    'name:f:3=ürs': 0.42,
    'name:f:3=ürt': -0.15,
    'name:f:3=üss': 0.15,
    'name:f:3=ütz': 0.45,
    'name:f:3=üße': -1.71,
    'name:f:T': 0.21,
    'name:f:U': -0.47,
    'name:f:X': -1.86,
    'name:f:adv': -2.13,
    'name:f:c=known': -1.81,
    'name:f:c=proper': 0.34,
    'name:f:c=rare': 0.49,
    'name:f:c=seldom': -1.04,
    'name:f:c=top': -1.42,
    'name:f:closed': -2.37,
    'name:f:det': -0.14,
    'name:f:joined': 1.24,
    'name:f:l': -0.84,
    'name:f:n=2': -1.77,
    'name:f:n=3': -0.65,
    'name:f:n=4': -1.07,
    'name:f:n=8': 0.17,
    'name:f:n=9': 0.41,
    'name:f:no_vowel': -2.5,
    'name:f:p': 1.1,
    'name:f:prep': -0.23,
    'name:f:pron': -0.1,
    'name:f:title': -0.37,
    'name:form:fg': 1.1,
    'name:form:fi': 2.01,
    'name:form:gf': -0.72,
    'name:form:ggf': -1.45,
    'name:form:gif': 3.19,
    'name:form:if': 0.46,
    'name:form:low': -0.84,
    'name:g:2=aa': 1.16,
    'name:g:2=ad': -0.7,
    'name:g:2=ae': 0.93,
    'name:g:2=af': -0.43,
    'name:g:2=ag': -0.79,
    'name:g:2=ak': 0.66,
    'name:g:2=al': -1.8,
    'name:g:2=am': -0.83,
    'name:g:2=an': 0.46,
    'name:g:2=ao': 1.15,
    'name:g:2=ap': -0.63,
    'name:g:2=ar': -1.39,
    'name:g:2=as': 0.44,
    'name:g:2=at': -0.47,
    'name:g:2=au': -0.36,
    'name:g:2=ay': 0.4,
    'name:g:2=ba': 0.64,
    'name:g:2=be': -0.99,
    'name:g:2=bx': -1.36,
    'name:g:2=by': -0.3,
    'name:g:2=ce': -1.13,
    'name:g:2=ch': -0.43,
    'name:g:2=ci': -0.56,
    'name:g:2=ck': -0.97,
    'name:g:2=cs': -0.1,
    'name:g:2=ct': -0.73,
    'name:g:2=da': 0.5,
    'name:g:2=de': -0.27,
    'name:g:2=di': 1.37,
    'name:g:2=dr': -0.19,
    'name:g:2=ds': -0.84,
    'name:g:2=dy': 1.22,
    'name:g:2=ea': 0.29,
    'name:g:2=eb': -1.12,
    'name:g:2=ed': -0.21,
    'name:g:2=ee': -0.41,
    'name:g:2=ef': -0.52,
    'name:g:2=eg': 0.24,
    'name:g:2=ei': 0.26,
    'name:g:2=el': 0.86,
    'name:g:2=em': 0.45,
    'name:g:2=en': -0.12,
    'name:g:2=eo': 1.46,
    'name:g:2=ep': 0.12,
    'name:g:2=er': -0.83,
    'name:g:2=es': 0.37,
    'name:g:2=et': 0.33,
    'name:g:2=ex': 0.39,
    'name:g:2=ez': -1.44,
    'name:g:2=fa': 0.31,
    'name:g:2=fo': 0.31,
    'name:g:2=ft': -1.41,
    'name:g:2=fy': 0.65,
    'name:g:2=ga': 0.37,
    'name:g:2=ge': 1.0,
    'name:g:2=go': 0.93,
    'name:g:2=gy': 1.07,
    'name:g:2=ha': -0.45,
    'name:g:2=he': -0.54,
    'name:g:2=hi': 0.6,
    'name:g:2=hl': -1.09,
    'name:g:2=hn': 1.82,
    'name:g:2=ho': -0.11,
    'name:g:2=ht': -1.51,
    'name:g:2=hu': 0.5,
    'name:g:2=hy': -0.99,
    'name:g:2=hé': -0.39,
    'name:g:2=ia': 1.68,
    'name:g:2=ib': 0.13,
    'name:g:2=id': 1.81,
    'name:g:2=ie': 0.42,
    'name:g:2=if': -0.83,
    'name:g:2=ig': 0.45,
    'name:g:2=ik': 1.05,
    'name:g:2=il': -0.3,
    'name:g:2=im': -0.72,
    'name:g:2=in': 0.7,
    'name:g:2=io': 0.53,
    'name:g:2=ip': -0.46,
    'name:g:2=is': -1.43,
    'name:g:2=it': -0.13,
    'name:g:2=ix': 0.42,
    'name:g:2=iy': 0.89,
    'name:g:2=iz': 0.2,
    'name:g:2=ja': -0.87,
    'name:g:2=jo': 0.64,
    'name:g:2=ka': 1.18,
    'name:g:2=kd': -1.43,
    'name:g:2=ke': 1.08,
    'name:g:2=ki': 1.88,
    'name:g:2=ko': 1.49,
    'name:g:2=ku': 0.24,
    'name:g:2=ky': 1.19,
    'name:g:2=kz': -2.03,
    'name:g:2=ké': 0.17,
    'name:g:2=kü': -1.16,
    'name:g:2=la': 0.9,
    'name:g:2=ld': -1.5,
    'name:g:2=lo': 0.62,
    'name:g:2=lt': -0.62,
    'name:g:2=lu': -0.89,
    'name:g:2=ly': -0.55,
    'name:g:2=lé': -0.45,
    'name:g:2=lö': -0.48,
    'name:g:2=lü': 0.24,
    'name:g:2=ma': 0.74,
    'name:g:2=me': 0.46,
    'name:g:2=mh': 1.17,
    'name:g:2=mo': 0.54,
    'name:g:2=mr': -0.15,
    'name:g:2=ms': -0.89,
    'name:g:2=my': 0.52,
    'name:g:2=na': 1.36,
    'name:g:2=ne': 0.44,
    'name:g:2=ng': -0.9,
    'name:g:2=ni': 0.39,
    'name:g:2=nk': -0.84,
    'name:g:2=nn': -0.32,
    'name:g:2=no': -0.78,
    'name:g:2=nr': -1.09,
    'name:g:2=ns': -0.29,
    'name:g:2=nt': -1.1,
    'name:g:2=ny': 1.21,
    'name:g:2=oa': 1.13,
    'name:g:2=ob': 0.95,
    'name:g:2=od': 0.23,
    'name:g:2=oe': 1.2,
    'name:g:2=of': -0.42,
    'name:g:2=og': 0.27,
    'name:g:2=ok': -0.59,
    'name:g:2=ol': -0.97,
    'name:g:2=om': 0.34,
    'name:g:2=on': -0.59,
    'name:g:2=oo': 0.49,
    'name:g:2=op': -0.32,
    'name:g:2=or': -1.49,
    'name:g:2=os': -0.6,
    'name:g:2=ot': 0.76,
    'name:g:2=ou': -0.6,
    'name:g:2=ow': -1.27,
    'name:g:2=ox': -0.32,
    'name:g:2=oy': 0.96,
    'name:g:2=oz': -0.84,
    'name:g:2=pa': 1.02,
    'name:g:2=po': 0.52,
    'name:g:2=ps': -0.6,
    'name:g:2=pt': -0.27,
    'name:g:2=px': -0.98,
    'name:g:2=py': 0.63,
    'name:g:2=pz': -0.65,
    'name:g:2=ra': 0.67,
    'name:g:2=rd': -0.39,
    'name:g:2=re': -0.66,
    'name:g:2=ri': 1.37,
    'name:g:2=rk': -0.35,
    'name:g:2=rl': -0.2,
    'name:g:2=rn': -0.95,
    'name:g:2=ro': -0.31,
    'name:g:2=rr': -1.07,
    'name:g:2=rs': -0.5,
    'name:g:2=rt': -0.97,
    'name:g:2=ru': 0.44,
    'name:g:2=ry': -0.81,
    'name:g:2=rz': -1.21,
    'name:g:2=ré': -0.46,
    'name:g:2=rö': -0.26,
    'name:g:2=rü': 0.39,
    'name:g:2=sa': 0.73,
    'name:g:2=se': -0.34,
    'name:g:2=sh': 1.24,
    'name:g:2=si': -0.11,
    'name:g:2=sk': -1.67,
    'name:g:2=so': 1.32,
    'name:g:2=ss': -0.53,
    'name:g:2=st': -1.44,
    'name:g:2=sy': 1.17,
    'name:g:2=sö': 0.37,
    'name:g:2=ta': 0.84,
    'name:g:2=te': -0.68,
    'name:g:2=th': -0.78,
    'name:g:2=to': 0.41,
    'name:g:2=ts': -0.77,
    'name:g:2=tt': -0.22,
    'name:g:2=ty': -0.75,
    'name:g:2=tz': -0.48,
    'name:g:2=tá': -1.59,
    'name:g:2=té': -0.21,
    'name:g:2=tü': 0.49,
    'name:g:2=ua': 0.93,
    'name:g:2=uc': 1.73,
    'name:g:2=ud': -0.84,
    'name:g:2=ue': -0.36,
    'name:g:2=uf': -0.46,
    'name:g:2=ug': -0.55,
    'name:g:2=um': -0.55,
    'name:g:2=un': -0.39,
    'name:g:2=up': 0.41,
    'name:g:2=ur': -0.91,
    'name:g:2=us': 2.03,
    'name:g:2=ut': -1.28,
    'name:g:2=ux': 0.33,
    'name:g:2=uy': 1.47,
    'name:g:2=uz': 0.62,
    'name:g:2=va': -0.8,
    'name:g:2=vd': -0.32,
    'name:g:2=ve': -0.95,
    'name:g:2=vo': 0.28,
    'name:g:2=vx': -1.25,
    'name:g:2=wa': -0.54,
    'name:g:2=we': -0.74,
    'name:g:2=wn': -1.07,
    'name:g:2=wo': -0.93,
    'name:g:2=wé': -0.35,
    'name:g:2=xa': 0.54,
    'name:g:2=xe': 1.01,
    'name:g:2=xo': 0.43,
    'name:g:2=xy': 0.71,
    'name:g:2=ya': 1.14,
    'name:g:2=yo': 0.52,
    'name:g:2=za': -0.27,
    'name:g:2=ze': 0.95,
    'name:g:2=zo': 1.09,
    'name:g:2=zy': 1.19,
    'name:g:2=éa': 0.42,
    'name:g:2=én': -0.68,
    'name:g:2=éo': 0.36,
    'name:g:2=ép': -0.84,
    'name:g:2=éy': 0.55,
    'name:g:2=éz': 0.2,
    'name:g:2=ês': 1.29,
    'name:g:2=ía': 1.61,
    'name:g:2=ío': 1.36,
    'name:g:2=ón': -0.49,
    'name:g:2=öa': 0.62,
    'name:g:2=öe': 0.25,
    'name:g:2=öf': -0.2,
    'name:g:2=ög': -0.23,
    'name:g:2=ön': -0.28,
    'name:g:2=öo': 0.63,
    'name:g:2=ör': -0.96,
    'name:g:2=öy': 0.89,
    'name:g:2=öz': -0.37,
    'name:g:2=ún': -1.23,
    'name:g:2=üa': 0.61,
    'name:g:2=üe': 1.06,
    'name:g:2=üf': -0.44,
    'name:g:2=ül': -0.19,
    'name:g:2=üm': 0.27,
    'name:g:2=üo': 0.84,
    'name:g:2=üp': -0.12,
    'name:g:2=ür': -0.1,
    'name:g:2=üx': -0.67,
    'name:g:2=üy': 0.7,
    'name:g:2=üz': 0.29,
    'name:g:3=abe': -1.44,
    'name:g:3=ach': -1.66,
    'name:g:3=ack': -0.87,
    'name:g:3=aed': 0.61,
    'name:g:3=aee': 0.85,
    'name:g:3=ael': 0.65,
    'name:g:3=aen': -0.76,
    'name:g:3=aeo': 0.53,
    'name:g:3=aer': 0.13,
    'name:g:3=aey': 0.42,
    'name:g:3=afe': -0.21,
    'name:g:3=age': -1.39,
    'name:g:3=ahl': -1.09,
    'name:g:3=aia': 0.66,
    'name:g:3=aie': 0.29,
    'name:g:3=aig': -0.22,
    'name:g:3=aik': -0.4,
    'name:g:3=ail': -0.32,
    'name:g:3=aim': 0.14,
    'name:g:3=ain': -0.78,
    'name:g:3=aio': 0.78,
    'name:g:3=ait': -0.68,
    'name:g:3=aiy': 0.31,
    'name:g:3=aiz': 0.3,
    'name:g:3=aja': -0.49,
    'name:g:3=ala': -0.4,
    'name:g:3=all': -0.44,
    'name:g:3=am': -0.57,
    'name:g:3=ame': 1.23,
    'name:g:3=amh': 1.17,
    'name:g:3=an': -0.31,
    'name:g:3=ana': -0.5,
    'name:g:3=and': -0.35,
    'name:g:3=ane': 0.41,
    'name:g:3=ang': 0.74,
    'name:g:3=ank': 0.21,
    'name:g:3=ann': -0.38,
    'name:g:3=ans': 1.21,
    'name:g:3=apa': 0.27,
    'name:g:3=ara': 0.74,
    'name:g:3=ard': -0.27,
    'name:g:3=ark': -0.76,
    'name:g:3=arl': -0.7,
    'name:g:3=arn': 0.53,
    'name:g:3=ars': -0.54,
    'name:g:3=art': -1.12,
    'name:g:3=ary': -0.66,
    'name:g:3=ase': 0.75,
    'name:g:3=ask': -1.67,
    'name:g:3=ast': -0.28,
    'name:g:3=ate': -0.86,
    'name:g:3=att': 0.2,
    'name:g:3=aua': 0.11,
    'name:g:3=aue': 0.97,
    'name:g:3=auf': -0.69,
    'name:g:3=aug': 0.25,
    'name:g:3=aum': 0.45,
    'name:g:3=aun': -0.39,
    'name:g:3=auo': 0.54,
    'name:g:3=aus': 0.47,
    'name:g:3=aut': -1.22,
    'name:g:3=aux': -0.47,
    'name:g:3=auy': 0.45,
    'name:g:3=ave': -0.64,
    'name:g:3=aza': -1.12,
    'name:g:3=bel': 0.43,
    'name:g:3=bes': -2.02,
    'name:g:3=bia': 0.71,
    'name:g:3=bin': -1.26,
    'name:g:3=ble': -1.31,
    'name:g:3=bli': -0.31,
    'name:g:3=blo': 1.06,
    'name:g:3=blé': 0.42,
    'name:g:3=blü': 0.26,
    'name:g:3=bri': 0.55,
    'name:g:3=cha': -0.16,
    'name:g:3=che': 0.64,
    'name:g:3=chi': -0.46,
    'name:g:3=cho': -0.32,
    'name:g:3=cht': -0.75,
    'name:g:3=chy': 1.12,
    'name:g:3=ché': -0.17,
    'name:g:3=cka': 0.91,
    'name:g:3=cke': 0.29,
    'name:g:3=cko': 0.83,
    'name:g:3=cky': 0.54,
    'name:g:3=cli': 0.38,
    'name:g:3=clé': -1.12,
    'name:g:3=con': -0.16,
    'name:g:3=ct': -0.1,
    'name:g:3=cía': 1.61,
    'name:g:3=cío': 1.36,
    'name:g:3=dar': -0.58,
    'name:g:3=das': -1.48,
    'name:g:3=del': -0.8,
    'name:g:3=den': -1.08,
    'name:g:3=der': -1.76,
    'name:g:3=dia': 0.78,
    'name:g:3=die': -0.45,
    'name:g:3=din': 0.95,
    'name:g:3=dle': -1.29,
    'name:g:3=dos': -0.88,
    'name:g:3=dot': -0.74,
    'name:g:3=dr': -0.19,
    'name:g:3=dra': -0.35,
    'name:g:3=dus': 0.93,
    'name:g:3=eaa': 0.46,
    'name:g:3=eae': 1.28,
    'name:g:3=eal': -0.15,
    'name:g:3=eao': 0.52,
    'name:g:3=eap': -0.41,
    'name:g:3=ear': -0.27,
    'name:g:3=eas': -0.96,
    'name:g:3=eau': -0.34,
    'name:g:3=eay': 0.2,
    'name:g:3=eaz': -0.1,
    'name:g:3=eba': 0.16,
    'name:g:3=ebe': -0.99,
    'name:g:3=ech': -1.2,
    'name:g:3=ect': -0.67,
    'name:g:3=eel': 0.73,
    'name:g:3=een': -1.9,
    'name:g:3=eer': -0.58,
    'name:g:3=eft': -1.29,
    'name:g:3=ega': -0.57,
    'name:g:3=ehe': -1.38,
    'name:g:3=eia': 0.78,
    'name:g:3=eid': -0.38,
    'name:g:3=eie': 0.95,
    'name:g:3=eif': -0.24,
    'name:g:3=ein': 0.48,
    'name:g:3=eio': 0.83,
    'name:g:3=eis': 0.16,
    'name:g:3=eiy': 0.51,
    'name:g:3=ell': -0.3,
    'name:g:3=ema': 0.44,
    'name:g:3=ena': 0.87,
    'name:g:3=end': -0.44,
    'name:g:3=eng': 0.58,
    'name:g:3=enk': -0.43,
    'name:g:3=enn': 0.88,
    'name:g:3=ent': -0.47,
    'name:g:3=eny': 0.32,
    'name:g:3=epe': 0.48,
    'name:g:3=erd': -0.3,
    'name:g:3=ere': -0.12,
    'name:g:3=erk': -0.51,
    'name:g:3=erl': 0.3,
    'name:g:3=ern': -1.01,
    'name:g:3=ero': 0.18,
    'name:g:3=err': -1.07,
    'name:g:3=ers': -0.41,
    'name:g:3=ery': 1.01,
    'name:g:3=esa': -0.34,
    'name:g:3=esh': 1.24,
    'name:g:3=eso': 0.57,
    'name:g:3=ess': -0.25,
    'name:g:3=est': -1.42,
    'name:g:3=eto': 0.13,
    'name:g:3=ety': -0.47,
    'name:g:3=eue': -1.3,
    'name:g:3=eug': -0.97,
    'name:g:3=eus': 0.54,
    'name:g:3=exy': 0.17,
    'name:g:3=ezo': 0.49,
    'name:g:3=ezy': 0.5,
    'name:g:3=fae': 0.12,
    'name:g:3=fee': -0.52,
    'name:g:3=fel': 0.33,
    'name:g:3=fia': 0.44,
    'name:g:3=fin': 0.38,
    'name:g:3=fla': -0.68,
    'name:g:3=fli': 0.2,
    'name:g:3=fpx': -0.58,
    'name:g:3=fra': 0.59,
    'name:g:3=fri': 0.11,
    'name:g:3=fus': 0.21,
    'name:g:3=gel': 0.86,
    'name:g:3=gen': 1.65,
    'name:g:3=ger': -0.84,
    'name:g:3=get': -1.07,
    'name:g:3=ght': -1.2,
    'name:g:3=gia': 0.67,
    'name:g:3=gin': 0.8,
    'name:g:3=go': 0.38,
    'name:g:3=goa': 0.47,
    'name:g:3=gus': 0.63,
    'name:g:3=gún': -1.23,
    'name:g:3=haa': 0.37,
    'name:g:3=hae': -0.19,
    'name:g:3=hai': -0.42,
    'name:g:3=has': -1.38,
    'name:g:3=hau': -0.36,
    'name:g:3=hea': -0.62,
    'name:g:3=hei': 0.15,
    'name:g:3=hel': 0.87,
    'name:g:3=hen': -0.66,
    'name:g:3=her': -1.36,
    'name:g:3=hia': 0.53,
    'name:g:3=hie': 0.66,
    'name:g:3=hin': 0.26,
    'name:g:3=hio': 0.3,
    'name:g:3=hoo': -0.72,
    'name:g:3=hua': 0.39,
    'name:g:3=hus': 0.32,
    'name:g:3=höy': 0.71,
    'name:g:3=ial': -1.31,
    'name:g:3=ice': -1.12,
    'name:g:3=ich': 1.56,
    'name:g:3=ick': -0.45,
    'name:g:3=id': -0.83,
    'name:g:3=ida': -0.19,
    'name:g:3=idi': 1.28,
    'name:g:3=ido': -0.89,
    'name:g:3=iea': 0.29,
    'name:g:3=ieb': -0.32,
    'name:g:3=ied': -0.39,
    'name:g:3=iee': 0.75,
    'name:g:3=ief': -0.55,
    'name:g:3=iel': 0.82,
    'name:g:3=iem': -0.64,
    'name:g:3=ien': -0.34,
    'name:g:3=ieo': 0.14,
    'name:g:3=iep': -0.33,
    'name:g:3=ier': -0.47,
    'name:g:3=ies': 0.18,
    'name:g:3=iet': 0.12,
    'name:g:3=iex': 0.14,
    'name:g:3=iey': 1.02,
    'name:g:3=igo': 0.12,
    'name:g:3=iia': 0.8,
    'name:g:3=iin': 0.89,
    'name:g:3=ill': 0.61,
    'name:g:3=ily': 0.15,
    'name:g:3=im': -0.44,
    'name:g:3=ima': 1.7,
    'name:g:3=in': -2.28,
    'name:g:3=ina': -0.8,
    'name:g:3=ind': 0.48,
    'name:g:3=ine': -0.94,
    'name:g:3=ing': -0.88,
    'name:g:3=ink': -0.29,
    'name:g:3=inn': -0.22,
    'name:g:3=ino': -0.39,
    'name:g:3=ioa': 0.35,
    'name:g:3=ioe': 0.55,
    'name:g:3=iog': -0.21,
    'name:g:3=iok': -0.64,
    'name:g:3=ion': -0.9,
    'name:g:3=ioo': 0.58,
    'name:g:3=ios': -0.36,
    'name:g:3=ioy': 0.34,
    'name:g:3=ipa': 0.22,
    'name:g:3=ipe': 0.89,
    'name:g:3=ird': 0.31,
    'name:g:3=ire': -0.68,
    'name:g:3=irk': 0.51,
    'name:g:3=irl': -0.47,
    'name:g:3=irn': -0.24,
    'name:g:3=irt': -0.12,
    'name:g:3=iso': 0.48,
    'name:g:3=iss': -0.11,
    'name:g:3=ist': -0.98,
    'name:g:3=ita': -0.97,
    'name:g:3=ite': -0.79,
    'name:g:3=ito': 0.12,
    'name:g:3=itt': -0.19,
    'name:g:3=ity': -1.22,
    'name:g:3=itz': 0.13,
    'name:g:3=ius': 0.85,
    'name:g:3=ión': -0.49,
    'name:g:3=jan': 1.67,
    'name:g:3=kas': 1.81,
    'name:g:3=kay': 0.24,
    'name:g:3=kel': 1.01,
    'name:g:3=kia': 0.61,
    'name:g:3=kie': 0.58,
    'name:g:3=kin': 0.97,
    'name:g:3=kna': -0.49,
    'name:g:3=kne': -0.67,
    'name:g:3=kob': 1.91,
    'name:g:3=koo': 0.32,
    'name:g:3=kus': 0.77,
    'name:g:3=la': 0.41,
    'name:g:3=laa': 0.12,
    'name:g:3=lae': -0.16,
    'name:g:3=lai': 0.46,
    'name:g:3=lan': -0.19,
    'name:g:3=lao': 0.34,
    'name:g:3=lea': 0.19,
    'name:g:3=led': -0.1,
    'name:g:3=lee': 0.16,
    'name:g:3=lel': 0.52,
    'name:g:3=lex': 0.13,
    'name:g:3=ley': -0.69,
    'name:g:3=lia': 0.54,
    'name:g:3=lid': -0.66,
    'name:g:3=lie': 0.24,
    'name:g:3=lin': 0.44,
    'name:g:3=lio': -0.31,
    'name:g:3=lix': 1.04,
    'name:g:3=lla': -0.85,
    'name:g:3=lle': 0.82,
    'name:g:3=llo': 0.19,
    'name:g:3=lly': 0.74,
    'name:g:3=lon': -0.45,
    'name:g:3=loo': -0.12,
    'name:g:3=los': 1.49,
    'name:g:3=lou': -0.94,
    'name:g:3=lth': -0.78,
    'name:g:3=luc': 1.73,
    'name:g:3=luo': 0.14,
    'name:g:3=lus': 0.72,
    'name:g:3=ma': 0.15,
    'name:g:3=mas': 2.33,
    'name:g:3=med': 1.1,
    'name:g:3=mel': 0.44,
    'name:g:3=mer': -1.03,
    'name:g:3=mes': 2.54,
    'name:g:3=mia': 0.27,
    'name:g:3=mie': 0.61,
    'name:g:3=min': 0.68,
    'name:g:3=mme': -0.78,
    'name:g:3=mon': 0.77,
    'name:g:3=mos': -0.97,
    'name:g:3=mpe': -1.37,
    'name:g:3=mr': -0.15,
    'name:g:3=mus': 0.34,
    'name:g:3=nai': -0.62,
    'name:g:3=nal': -1.24,
    'name:g:3=nat': -0.65,
    'name:g:3=nda': 1.2,
    'name:g:3=nde': -0.34,
    'name:g:3=ndo': 0.44,
    'name:g:3=ndy': 0.27,
    'name:g:3=ned': -0.28,
    'name:g:3=nei': 0.53,
    'name:g:3=nel': 0.81,
    'name:g:3=ner': -1.45,
    'name:g:3=nga': 0.75,
    'name:g:3=nge': 0.89,
    'name:g:3=ngo': 0.47,
    'name:g:3=ngy': 0.83,
    'name:g:3=nia': 0.92,
    'name:g:3=nie': 0.41,
    'name:g:3=nin': 0.74,
    'name:g:3=nio': 0.11,
    'name:g:3=nka': 0.18,
    'name:g:3=nke': 0.94,
    'name:g:3=nko': 0.82,
    'name:g:3=nky': 0.13,
    'name:g:3=nna': 2.14,
    'name:g:3=nne': 0.61,
    'name:g:3=nno': 0.65,
    'name:g:3=nny': 0.53,
    'name:g:3=noo': 0.66,
    'name:g:3=nou': -0.28,
    'name:g:3=nr': -1.01,
    'name:g:3=nta': -0.24,
    'name:g:3=nte': -0.95,
    'name:g:3=nts': -0.3,
    'name:g:3=nus': 0.75,
    'name:g:3=nês': 1.29,
    'name:g:3=oad': -1.4,
    'name:g:3=och': 0.41,
    'name:g:3=ock': -0.61,
    'name:g:3=odo': 0.13,
    'name:g:3=oel': 0.84,
    'name:g:3=oge': 0.13,
    'name:g:3=ohn': 1.82,
    'name:g:3=oia': 0.66,
    'name:g:3=oin': 1.24,
    'name:g:3=oja': -0.37,
    'name:g:3=old': -1.44,
    'name:g:3=ole': -1.41,
    'name:g:3=oll': 0.71,
    'name:g:3=omo': 0.3,
    'name:g:3=omy': 0.14,
    'name:g:3=ond': 0.48,
    'name:g:3=ong': -1.22,
    'name:g:3=onk': 0.64,
    'name:g:3=onn': -0.39,
    'name:g:3=ons': -1.59,
    'name:g:3=ooa': 0.63,
    'name:g:3=oob': -0.26,
    'name:g:3=ooe': 0.44,
    'name:g:3=oof': 0.23,
    'name:g:3=ook': -0.12,
    'name:g:3=ool': -0.93,
    'name:g:3=ooo': -0.2,
    'name:g:3=oor': -1.41,
    'name:g:3=oox': -0.1,
    'name:g:3=ooy': 0.26,
    'name:g:3=opo': 0.12,
    'name:g:3=ord': -0.64,
    'name:g:3=orl': 1.02,
    'name:g:3=orn': 0.67,
    'name:g:3=ors': 0.78,
    'name:g:3=ort': -0.69,
    'name:g:3=ory': -0.97,
    'name:g:3=ose': 0.14,
    'name:g:3=oss': -0.44,
    'name:g:3=ost': 0.69,
    'name:g:3=ote': -0.82,
    'name:g:3=oto': 0.22,
    'name:g:3=ott': 0.37,
    'name:g:3=otz': -0.27,
    'name:g:3=oua': 0.41,
    'name:g:3=oue': 0.63,
    'name:g:3=ouf': 0.74,
    'name:g:3=oug': -0.29,
    'name:g:3=ouo': 0.41,
    'name:g:3=ous': 0.64,
    'name:g:3=out': 0.11,
    'name:g:3=ouy': 0.29,
    'name:g:3=ove': -0.54,
    'name:g:3=own': -1.07,
    'name:g:3=oxy': 0.59,
    'name:g:3=pel': 0.65,
    'name:g:3=per': -1.9,
    'name:g:3=phy': -1.17,
    'name:g:3=pia': 0.44,
    'name:g:3=pin': 0.33,
    'name:g:3=pla': -0.24,
    'name:g:3=ple': 0.27,
    'name:g:3=pte': -0.32,
    'name:g:3=pus': 0.48,
    'name:g:3=pz': -0.65,
    'name:g:3=que': 0.16,
    'name:g:3=quo': -0.53,
    'name:g:3=rae': 0.18,
    'name:g:3=rag': -0.83,
    'name:g:3=rai': 0.26,
    'name:g:3=ral': -1.02,
    'name:g:3=rar': 0.46,
    'name:g:3=rau': -1.58,
    'name:g:3=rci': -0.56,
    'name:g:3=rda': 0.32,
    'name:g:3=rde': -0.35,
    'name:g:3=rdo': 0.73,
    'name:g:3=rds': -0.11,
    'name:g:3=rdy': 0.79,
    'name:g:3=rea': -0.44,
    'name:g:3=red': -1.54,
    'name:g:3=ree': 0.24,
    'name:g:3=rei': 0.8,
    'name:g:3=res': -1.25,
    'name:g:3=rge': 1.91,
    'name:g:3=ria': -0.95,
    'name:g:3=rib': -0.17,
    'name:g:3=rid': 1.46,
    'name:g:3=rie': 0.62,
    'name:g:3=rik': 1.14,
    'name:g:3=rin': 0.69,
    'name:g:3=rio': 0.37,
    'name:g:3=rka': 0.9,
    'name:g:3=rke': 0.43,
    'name:g:3=rko': 0.53,
    'name:g:3=rky': 0.69,
    'name:g:3=rla': 0.73,
    'name:g:3=rle': 0.81,
    'name:g:3=rlo': 1.03,
    'name:g:3=rly': -0.82,
    'name:g:3=rna': 0.81,
    'name:g:3=rne': 1.55,
    'name:g:3=rno': 0.54,
    'name:g:3=rny': 0.56,
    'name:g:3=ron': -0.1,
    'name:g:3=roo': 0.28,
    'name:g:3=roy': 0.11,
    'name:g:3=rre': 1.37,
    'name:g:3=rrn': -1.41,
    'name:g:3=rsa': 0.6,
    'name:g:3=rso': 0.32,
    'name:g:3=rsy': 0.68,
    'name:g:3=rta': 0.16,
    'name:g:3=rte': 0.94,
    'name:g:3=rto': 0.66,
    'name:g:3=rty': 1.04,
    'name:g:3=see': -0.91,
    'name:g:3=sel': -0.95,
    'name:g:3=seo': -1.28,
    'name:g:3=ses': -1.09,
    'name:g:3=sia': 0.6,
    'name:g:3=sin': 0.65,
    'name:g:3=sle': 0.19,
    'name:g:3=son': -1.32,
    'name:g:3=ssa': 0.89,
    'name:g:3=sse': -0.7,
    'name:g:3=sso': 0.63,
    'name:g:3=ssy': 0.55,
    'name:g:3=sta': 0.95,
    'name:g:3=ste': -0.43,
    'name:g:3=sto': 0.84,
    'name:g:3=sty': 0.41,
    'name:g:3=stá': -1.59,
    'name:g:3=sus': 0.76,
    'name:g:3=tea': 0.8,
    'name:g:3=ted': -0.64,
    'name:g:3=tei': -1.35,
    'name:g:3=tel': 0.31,
    'name:g:3=ten': -1.25,
    'name:g:3=teo': 1.62,
    'name:g:3=ter': 1.7,
    'name:g:3=the': -0.17,
    'name:g:3=tia': 0.73,
    'name:g:3=tie': 0.26,
    'name:g:3=tin': 2.5,
    'name:g:3=tio': 0.91,
    'name:g:3=ton': -0.82,
    'name:g:3=tre': -0.96,
    'name:g:3=tri': 0.7,
    'name:g:3=tta': 0.8,
    'name:g:3=tte': 1.03,
    'name:g:3=tto': 0.53,
    'name:g:3=tty': 1.16,
    'name:g:3=tur': -0.85,
    'name:g:3=two': -0.93,
    'name:g:3=tya': 1.06,
    'name:g:3=tza': 0.67,
    'name:g:3=tze': 0.8,
    'name:g:3=tzo': 0.54,
    'name:g:3=tzy': 0.67,
    'name:g:3=tür': -0.1,
    'name:g:3=ual': -0.93,
    'name:g:3=uan': 0.56,
    'name:g:3=uch': -0.22,
    'name:g:3=uck': 0.34,
    'name:g:3=uda': 0.31,
    'name:g:3=ude': 0.19,
    'name:g:3=uel': 1.38,
    'name:g:3=uer': -0.29,
    'name:g:3=uez': -1.45,
    'name:g:3=uge': -0.28,
    'name:g:3=uia': 0.9,
    'name:g:3=uin': 0.73,
    'name:g:3=uka': 0.51,
    'name:g:3=uki': 1.24,
    'name:g:3=ull': -0.35,
    'name:g:3=ulo': 0.28,
    'name:g:3=ung': -0.8,
    'name:g:3=unn': -0.22,
    'name:g:3=unt': -1.01,
    'name:g:3=ura': 1.06,
    'name:g:3=urd': 0.18,
    'name:g:3=ure': -1.15,
    'name:g:3=urk': 0.21,
    'name:g:3=urn': -0.26,
    'name:g:3=urs': -0.3,
    'name:g:3=urt': 0.9,
    'name:g:3=use': -1.46,
    'name:g:3=ust': -0.19,
    'name:g:3=utt': -0.53,
    'name:g:3=utz': -0.31,
    'name:g:3=uus': 0.51,
    'name:g:3=van': -0.51,
    'name:g:3=ver': -1.68,
    'name:g:3=vid': 1.88,
    'name:g:3=von': -0.42,
    'name:g:3=war': -1.67,
    'name:g:3=wen': 1.77,
    'name:g:3=who': 0.5,
    'name:g:3=xam': -0.66,
    'name:g:3=xel': 0.98,
    'name:g:3=xia': 0.27,
    'name:g:3=xin': 0.49,
    'name:g:3=zel': 0.43,
    'name:g:3=zia': 0.19,
    'name:g:3=zin': 0.74,
    'name:g:3=zum': -0.25,
    'name:g:3=zus': 0.48,
    'name:g:3=éel': 0.15,
    'name:g:3=éin': 1.03,
    'name:g:3=éng': 0.45,
    'name:g:3=énn': 0.26,
    'name:g:3=érd': 0.43,
    'name:g:3=érn': 0.49,
    'name:g:3=érs': -0.71,
    'name:g:3=étt': 0.32,
    'name:g:3=öch': 0.17,
    'name:g:3=öck': -0.38,
    'name:g:3=öel': 0.45,
    'name:g:3=öia': 0.17,
    'name:g:3=öin': 0.43,
    'name:g:3=örd': 0.19,
    'name:g:3=örk': 0.14,
    'name:g:3=örn': -0.11,
    'name:g:3=öss': 0.35,
    'name:g:3=ötz': -0.44,
    'name:g:3=öus': 0.27,
    'name:g:3=ück': -0.64,
    'name:g:3=üia': 0.17,
    'name:g:3=üin': 0.2,
    'name:g:3=üss': -0.51,
    'name:g:3=üst': 0.17,
    'name:g:3=ütt': -0.45,
    'name:g:3=üus': 0.43,
    'name:g:X': -2.02,
    'name:g:adv': -1.1,
    'name:g:c=known': -0.96,
    'name:g:c=proper': 1.19,
    'name:g:c=rare': 0.59,
    'name:g:c=seldom': -0.34,
    'name:g:c=top': -0.94,
    'name:g:closed': -1.41,
    'name:g:det': -1.36,
    'name:g:elided': -3.63,
    'name:g:l': -0.84,
    'name:g:n=2': -0.42,
    'name:g:n=3': -0.28,
    'name:g:n=7': -0.5,
    'name:g:n=8': 0.29,
    'name:g:n=9': -0.13,
    'name:g:no_vowel': -2.88,
    'name:g:prep': -1.18,
    'name:g:pron': 0.15,
    'name:g:title': -2.31,
    'name:line': 1.79,
    'name:line:': 0.26,
    'name:line:,': 1.74,
    'name:line:-': 1.6,
    'name:line:.': 0.49,
    'name:line:other': 1.11,
    'name:low:2=ae': -0.26,
    'name:low:2=ai': -0.46,
    'name:low:2=an': 0.49,
    'name:low:2=ar': -0.29,
    'name:low:2=as': 0.21,
    'name:low:2=ca': -0.61,
    'name:low:2=ch': -0.54,
    'name:low:2=ck': -0.44,
    'name:low:2=da': -0.24,
    'name:low:2=de': -0.59,
    'name:low:2=do': -0.96,
    'name:low:2=dé': -0.28,
    'name:low:2=ea': -0.42,
    'name:low:2=eb': -0.18,
    'name:low:2=ed': -0.15,
    'name:low:2=ei': 0.29,
    'name:low:2=el': 0.99,
    'name:low:2=em': -0.17,
    'name:low:2=en': 0.51,
    'name:low:2=et': -0.99,
    'name:low:2=ex': -0.23,
    'name:low:2=ft': -0.64,
    'name:low:2=ge': -0.49,
    'name:low:2=gt': -0.61,
    'name:low:2=he': 0.52,
    'name:low:2=ho': -0.12,
    'name:low:2=hü': -0.34,
    'name:low:2=ib': -0.28,
    'name:low:2=ic': 0.45,
    'name:low:2=id': 0.35,
    'name:low:2=ig': -0.49,
    'name:low:2=im': 0.19,
    'name:low:2=in': -0.85,
    'name:low:2=io': -0.33,
    'name:low:2=it': -0.11,
    'name:low:2=la': -0.19,
    'name:low:2=le': -0.19,
    'name:low:2=li': -0.24,
    'name:low:2=lo': -0.47,
    'name:low:2=lt': -0.97,
    'name:low:2=lu': -0.68,
    'name:low:2=lö': -0.35,
    'name:low:2=lü': -0.26,
    'name:low:2=me': -0.53,
    'name:low:2=mé': -0.18,
    'name:low:2=na': 0.2,
    'name:low:2=nd': -0.83,
    'name:low:2=nk': 0.63,
    'name:low:2=nn': -0.16,
    'name:low:2=no': -1.18,
    'name:low:2=né': -0.49,
    'name:low:2=od': -1.32,
    'name:low:2=of': -0.15,
    'name:low:2=ok': 0.29,
    'name:low:2=om': -0.36,
    'name:low:2=on': 0.74,
    'name:low:2=oo': -0.53,
    'name:low:2=os': 0.22,
    'name:low:2=ot': 0.56,
    'name:low:2=ou': -0.33,
    'name:low:2=ra': -0.4,
    'name:low:2=rd': -0.73,
    'name:low:2=re': -0.43,
    'name:low:2=rk': 0.17,
    'name:low:2=rl': -0.45,
    'name:low:2=rn': -0.65,
    'name:low:2=ro': -0.44,
    'name:low:2=rt': -0.23,
    'name:low:2=ré': -0.41,
    'name:low:2=rü': -0.14,
    'name:low:2=ss': 0.15,
    'name:low:2=st': -0.58,
    'name:low:2=to': 0.18,
    'name:low:2=tt': 0.42,
    'name:low:2=té': -0.27,
    'name:low:2=ub': -0.63,
    'name:low:2=ug': -0.14,
    'name:low:2=ul': -0.1,
    'name:low:2=us': -0.58,
    'name:low:2=ux': -0.16,
    'name:low:2=zt': -0.75,
    'name:low:2=ée': -0.77,
    'name:low:2=él': -0.68,
    'name:m:2=ag': -0.53,
    'name:m:2=al': -0.11,
    'name:m:2=am': -0.5,
    'name:m:2=as': -0.12,
    'name:m:2=ce': -0.16,
    'name:m:2=el': -0.24,
    'name:m:2=er': -0.31,
    'name:m:2=hy': -0.27,
    'name:m:2=ie': -0.18,
    'name:m:2=kz': -0.13,
    'name:m:2=ll': -0.12,
    'name:m:2=ly': -0.2,
    'name:m:2=na': -0.2,
    'name:m:2=nd': -0.11,
    'name:m:2=ng': -0.35,
    'name:m:2=ox': -0.11,
    'name:m:2=ug': -0.39,
    'name:m:3=ang': -0.33,
    'name:m:3=der': -0.21,
    'name:m:3=eam': -0.49,
    'name:m:3=ell': -0.12,
    'name:m:3=ena': -0.16,
    'name:m:3=ice': -0.11,
    'name:m:3=iel': -0.19,
    'name:m:3=phy': -0.27,
    'name:m:3=tag': -0.53,
    'name:m:T': -1.75,
    'name:m:U': -0.21,
    'name:m:c=known': -0.13,
    'name:m:c=proper': -0.55,
    'name:m:c=rare': -1.06,
    'name:m:c=seldom': -0.12,
    'name:m:c=top': -1.18,
    'name:m:closed': -0.28,
    'name:m:det': -0.25,
    'name:m:joined': -0.33,
    'name:m:n=3': -0.87,
    'name:m:n=4': -0.73,
    'name:m:n=5': -0.52,
    'name:m:n=6': -0.65,
    'name:m:n=7': -0.31,
    'name:m:n=8': -0.31,
    'name:m:n=9': -0.69,
    'name:m:no_vowel': -0.15,
    'name:m:p': -0.11,
    'name:mixed_case': -1.61,
    "name:n:'": 0.81,
    'name:n:(': 1.62,
    'name:n:+': -1.13,
    'name:n:,': 1.2,
    'name:n:.': 0.41,
    'name:n:2=ab': -0.17,
    'name:n:2=ad': -0.35,
    'name:n:2=ae': -0.28,
    'name:n:2=ai': -0.41,
    'name:n:2=al': -1.41,
    'name:n:2=am': -0.21,
    'name:n:2=an': -0.22,
    'name:n:2=ar': 0.69,
    'name:n:2=as': 2.12,
    'name:n:2=at': -0.86,
    'name:n:2=au': -0.59,
    'name:n:2=aw': 1.37,
    'name:n:2=ay': -1.15,
    'name:n:2=az': -0.37,
    'name:n:2=bt': -1.04,
    'name:n:2=ce': -0.87,
    'name:n:2=ch': -0.97,
    'name:n:2=ck': -0.66,
    'name:n:2=ct': 0.35,
    'name:n:2=da': -0.33,
    'name:n:2=ds': -0.55,
    'name:n:2=dy': 0.57,
    'name:n:2=ea': -0.81,
    'name:n:2=eb': -0.23,
    'name:n:2=ed': 2.16,
    'name:n:2=ee': 0.48,
    'name:n:2=ei': -0.55,
    'name:n:2=ek': -0.33,
    'name:n:2=em': -1.51,
    'name:n:2=en': 0.91,
    'name:n:2=ep': -0.31,
    'name:n:2=er': -0.53,
    'name:n:2=es': -1.22,
    'name:n:2=ex': -0.41,
    'name:n:2=ey': -0.18,
    'name:n:2=ez': -0.33,
    'name:n:2=ft': 1.54,
    'name:n:2=ge': -1.01,
    'name:n:2=gs': 2.12,
    'name:n:2=gt': 0.61,
    'name:n:2=ha': -0.25,
    'name:n:2=he': -0.39,
    'name:n:2=hi': -0.3,
    'name:n:2=ht': -0.12,
    'name:n:2=ib': -0.18,
    'name:n:2=ic': -0.31,
    'name:n:2=id': 1.7,
    'name:n:2=ie': -0.51,
    'name:n:2=if': -0.41,
    'name:n:2=ik': -0.2,
    'name:n:2=in': -0.37,
    'name:n:2=io': -0.48,
    'name:n:2=ip': -0.33,
    'name:n:2=ir': -0.26,
    'name:n:2=is': -1.95,
    'name:n:2=it': 0.24,
    'name:n:2=ix': -0.56,
    'name:n:2=ka': -0.25,
    'name:n:2=la': -0.15,
    'name:n:2=ld': 1.76,
    'name:n:2=le': -0.92,
    'name:n:2=li': -0.29,
    'name:n:2=ll': -0.36,
    'name:n:2=lo': -0.42,
    'name:n:2=ls': -1.17,
    'name:n:2=ly': -0.42,
    'name:n:2=lé': -0.32,
    'name:n:2=me': 1.66,
    'name:n:2=ms': -0.66,
    'name:n:2=mt': -0.82,
    'name:n:2=n': -1.0,
    'name:n:2=na': -0.2,
    'name:n:2=nd': -1.27,
    'name:n:2=ne': -1.78,
    'name:n:2=ng': -0.47,
    'name:n:2=ni': -0.48,
    'name:n:2=nk': -0.37,
    'name:n:2=nn': -0.59,
    'name:n:2=ns': -2.07,
    'name:n:2=nt': -0.62,
    'name:n:2=né': -0.13,
    'name:n:2=ob': -0.11,
    'name:n:2=od': 1.83,
    'name:n:2=og': -0.25,
    'name:n:2=ol': -0.51,
    'name:n:2=om': -0.11,
    'name:n:2=on': -1.29,
    'name:n:2=oo': -0.25,
    'name:n:2=or': -1.36,
    'name:n:2=os': 1.07,
    'name:n:2=ot': 0.91,
    'name:n:2=ou': -0.51,
    'name:n:2=ow': -0.57,
    'name:n:2=ox': -1.04,
    'name:n:2=p': 0.38,
    'name:n:2=ra': -1.25,
    'name:n:2=rd': -0.94,
    'name:n:2=re': -1.6,
    'name:n:2=ri': -0.11,
    'name:n:2=rk': -0.61,
    'name:n:2=rl': -0.64,
    'name:n:2=rm': -0.76,
    'name:n:2=rn': -0.38,
    'name:n:2=ro': -0.75,
    'name:n:2=rs': -1.83,
    'name:n:2=rt': 0.29,
    'name:n:2=ru': -0.13,
    'name:n:2=se': -0.5,
    'name:n:2=ss': -1.26,
    'name:n:2=te': 0.45,
    'name:n:2=th': -0.19,
    'name:n:2=ts': -0.16,
    'name:n:2=tt': -0.7,
    'name:n:2=ty': -0.93,
    'name:n:2=tz': -0.6,
    'name:n:2=tá': 0.49,
    'name:n:2=u': 0.3,
    'name:n:2=ue': -0.2,
    'name:n:2=un': -0.57,
    'name:n:2=ut': -1.14,
    'name:n:2=ux': -0.11,
    'name:n:2=vd': -0.27,
    'name:n:2=ve': 1.16,
    'name:n:2=wi': -0.12,
    'name:n:2=wn': -0.38,
    'name:n:2=x': -0.18,
    'name:n:2=xs': -0.97,
    'name:n:2=ys': -0.97,
    'name:n:2=zt': -0.46,
    'name:n:2=à': -0.39,
    'name:n::': -1.52,
    'name:n:;': 1.63,
    'name:n:<': 0.57,
    'name:n:cap': -1.12,
    'name:n:class=adv': -0.87,
    'name:n:class=conj': 0.19,
    'name:n:class=det': 0.21,
    'name:n:class=prep': -0.47,
    'name:n:class=pron': 0.65,
    'name:n:digit': -2.35,
    'name:n:line': 0.25,
    'name:n:spaced': 1.36,
    'name:n:word': -0.26,
    'name:n=0': -0.66,
    'name:n=00': -1.15,
    'name:n=000': -0.72,
    'name:n=00000000': -0.64,
    'name:n=0000000000': -0.44,
    'name:n=000b': -0.12,
    'name:n=a': 0.61,
    'name:n=amplifier': -1.22,
    'name:n=amplifiers': -0.7,
    'name:n=and': 0.21,
    'name:n=are': -1.23,
    'name:n=ayer': 1.95,
    'name:n=baker': -0.49,
    'name:n=bestellt': 0.34,
    'name:n=bestätigt': 1.22,
    'name:n=bezahlt': 1.02,
    'name:n=bis': -0.2,
    'name:n=bleibt': -0.61,
    'name:n=blvd': -0.13,
    'name:n=box': -0.95,
    'name:n=boxs': -0.65,
    'name:n=brought': 1.23,
    'name:n=cable': 0.15,
    'name:n=calendar': -0.17,
    'name:n=came': 0.83,
    'name:n=camera': -0.72,
    'name:n=candle': -0.16,
    'name:n=centrifuge': -0.45,
    'name:n=clock': -0.51,
    'name:n=close': -0.18,
    'name:n=closed': 0.68,
    'name:n=coffee': -0.21,
    'name:n=confirmed': -0.15,
    'name:n=costs': 1.6,
    'name:n=court': -0.17,
    'name:n=der': 0.34,
    'name:n=die': 0.89,
    'name:n=display': -0.42,
    'name:n=door': -0.25,
    'name:n=dot': -0.63,
    'name:n=drive': -0.42,
    'name:n=e': -0.11,
    'name:n=el': 1.41,
    'name:n=en': -0.46,
    'name:n=engine': -1.21,
    'name:n=est': -0.18,
    'name:n=evans': -0.26,
    'name:n=explained': 0.81,
    'name:n=fehlt': -0.29,
    'name:n=for': 0.47,
    'name:n=forgot': 0.57,
    'name:n=from': -1.91,
    'name:n=garden': -0.42,
    'name:n=gauge': -0.92,
    'name:n=gauges': -0.66,
    'name:n=gave': 1.06,
    'name:n=geliefert': 0.3,
    'name:n=geschrieben': -0.16,
    'name:n=gesprochen': 1.26,
    'name:n=gezählt': -0.92,
    'name:n=gut': -0.64,
    'name:n=hangs': 0.98,
    'name:n=hat': -0.31,
    'name:n=heater': -0.78,
    'name:n=heaters': -0.42,
    'name:n=hemos': 0.17,
    'name:n=i': -0.15,
    'name:n=im': -0.8,
    'name:n=in': -0.96,
    'name:n=index': -0.31,
    'name:n=insisted': 0.38,
    'name:n=is': -1.12,
    'name:n=ist': 0.51,
    'name:n=kommt': -0.53,
    'name:n=la': -0.86,
    'name:n=lasts': -2.15,
    'name:n=le': -0.35,
    'name:n=left': 0.59,
    'name:n=lens': -0.5,
    'name:n=lenss': -0.71,
    'name:n=light': -0.16,
    'name:n=matrix': -0.39,
    'name:n=melden': 0.3,
    'name:n=mentioned': 0.28,
    'name:n=meter': -0.64,
    'name:n=mit': -1.34,
    'name:n=motor': -0.58,
    'name:n=motors': -0.29,
    'name:n=n': -0.58,
    'name:n=no': -0.17,
    'name:n=nous': 0.99,
    'name:n=number': -0.65,
    'name:n=of': -1.25,
    'name:n=on': -0.96,
    'name:n=opened': 0.21,
    'name:n=opens': -1.29,
    'name:n=paid': -0.32,
    'name:n=place': -0.24,
    'name:n=printer': -0.9,
    'name:n=projector': -0.5,
    'name:n=promised': 1.12,
    'name:n=rd': -0.24,
    'name:n=reach': -0.13,
    'name:n=recorded': -0.11,
    'name:n=recorder': -0.84,
    'name:n=reicht': -1.36,
    'name:n=repaired': -0.47,
    'name:n=repariert': 0.45,
    'name:n=reported': 1.23,
    'name:n=road': -0.17,
    'name:n=romero': -0.13,
    'name:n=saw': 0.85,
    'name:n=scanner': -1.62,
    'name:n=screen': -0.82,
    'name:n=seit': 0.34,
    'name:n=sensor': -0.57,
    'name:n=showed': 1.11,
    'name:n=since': 1.37,
    'name:n=sincerely': -0.27,
    'name:n=sind': -0.81,
    'name:n=sitzt': -0.43,
    'name:n=speech': -0.13,
    'name:n=square': -0.14,
    'name:n=station': -1.21,
    'name:n=steht': -0.26,
    'name:n=stood': -0.25,
    'name:n=stopped': 0.28,
    'name:n=street': -0.38,
    'name:n=system': -1.05,
    'name:n=systems': -0.59,
    'name:n=terminal': -0.86,
    'name:n=terminals': -0.22,
    'name:n=terrace': -0.25,
    'name:n=thanked': 1.18,
    'name:n=that': 1.32,
    'name:n=the': -1.73,
    'name:n=theorem': -0.2,
    'name:n=three': -0.93,
    'name:n=to': 1.04,
    'name:n=told': 0.74,
    'name:n=tried': -0.34,
    'name:n=two': -0.23,
    'name:n=unit': -1.03,
    'name:n=units': -0.65,
    'name:n=unterrichtet': 0.22,
    'name:n=von': -0.21,
    'name:n=waited': -0.69,
    'name:n=wang': -0.19,
    'name:n=waren': -1.36,
    'name:n=warned': 0.11,
    'name:n=was': 1.01,
    'name:n=weather': -0.28,
    'name:n=window': -0.22,
    'name:n=wurde': -0.31,
    'name:n=x': -0.18,
    'name:n=you': -0.29,
    'name:n=zu': -0.17,
    'name:p:,': -1.11,
    'name:p:.': 0.48,
    'name:p:2=aa': -0.24,
    'name:p:2=ad': -0.23,
    'name:p:2=ae': 1.39,
    'name:p:2=ai': 0.79,
    'name:p:2=al': -0.53,
    'name:p:2=am': -0.34,
    'name:p:2=an': -2.15,
    'name:p:2=ar': -0.54,
    'name:p:2=as': -1.0,
    'name:p:2=aw': -0.59,
    'name:p:2=ax': 0.31,
    'name:p:2=ay': -0.13,
    'name:p:2=az': -0.57,
    'name:p:2=be': -2.35,
    'name:p:2=bt': -0.32,
    'name:p:2=bx': -0.63,
    'name:p:2=c': -0.25,
    'name:p:2=cc': 1.41,
    'name:p:2=ce': -0.26,
    'name:p:2=ck': -0.11,
    'name:p:2=ct': -2.94,
    'name:p:2=có': 1.17,
    'name:p:2=da': -0.51,
    'name:p:2=de': 0.61,
    'name:p:2=di': -0.58,
    'name:p:2=do': -1.91,
    'name:p:2=ds': 1.54,
    'name:p:2=du': -1.58,
    'name:p:2=dy': -0.44,
    'name:p:2=ea': -0.81,
    'name:p:2=eb': 0.15,
    'name:p:2=ed': 1.63,
    'name:p:2=ee': -0.84,
    'name:p:2=ef': -2.19,
    'name:p:2=ek': 0.29,
    'name:p:2=el': -1.62,
    'name:p:2=em': 0.53,
    'name:p:2=en': -0.96,
    'name:p:2=eo': -0.47,
    'name:p:2=er': 0.11,
    'name:p:2=es': -0.41,
    'name:p:2=et': -1.55,
    'name:p:2=eu': 0.55,
    'name:p:2=ex': 0.38,
    'name:p:2=ey': -0.64,
    'name:p:2=ez': 0.49,
    'name:p:2=ft': -0.51,
    'name:p:2=ga': -1.81,
    'name:p:2=ge': -0.77,
    'name:p:2=go': -0.99,
    'name:p:2=gt': -0.83,
    'name:p:2=gó': 1.78,
    'name:p:2=he': -0.65,
    'name:p:2=hl': -0.67,
    'name:p:2=hn': -0.71,
    'name:p:2=ho': 0.65,
    'name:p:2=ht': -0.3,
    'name:p:2=hu': 0.79,
    'name:p:2=hé': 0.74,
    'name:p:2=ia': -1.23,
    'name:p:2=ib': 1.26,
    'name:p:2=id': -0.26,
    'name:p:2=ie': -0.83,
    'name:p:2=if': 0.31,
    'name:p:2=ig': 0.39,
    'name:p:2=il': -0.79,
    'name:p:2=im': 0.16,
    'name:p:2=in': -0.43,
    'name:p:2=io': 0.35,
    'name:p:2=ir': 0.54,
    'name:p:2=is': 2.23,
    'name:p:2=it': -0.18,
    'name:p:2=ix': -1.17,
    'name:p:2=iz': 0.32,
    'name:p:2=ió': 2.48,
    'name:p:2=ja': -2.08,
    'name:p:2=jo': 0.92,
    'name:p:2=k': -0.51,
    'name:p:2=ka': -0.35,
    'name:p:2=kd': -0.49,
    'name:p:2=ke': -0.3,
    'name:p:2=ki': -0.18,
    'name:p:2=km': 0.21,
    'name:p:2=ko': -0.41,
    'name:p:2=ks': 0.12,
    'name:p:2=kt': 0.76,
    'name:p:2=ky': -0.68,
    'name:p:2=kz': -0.44,
    'name:p:2=la': -1.96,
    'name:p:2=ld': 0.92,
    'name:p:2=le': -0.66,
    'name:p:2=li': 0.39,
    'name:p:2=ll': 0.18,
    'name:p:2=lo': -0.25,
    'name:p:2=lt': -1.79,
    'name:p:2=ly': -0.79,
    'name:p:2=là': -0.22,
    'name:p:2=lö': 0.91,
    'name:p:2=lü': -0.25,
    'name:p:2=m': -0.31,
    'name:p:2=ma': -0.66,
    'name:p:2=me': -0.55,
    'name:p:2=mh': -0.27,
    'name:p:2=mó': 1.64,
    'name:p:2=n': -0.47,
    'name:p:2=na': -1.62,
    'name:p:2=nd': 1.0,
    'name:p:2=ne': -0.64,
    'name:p:2=ng': 0.1,
    'name:p:2=nk': 0.48,
    'name:p:2=nn': 0.6,
    'name:p:2=nt': 0.76,
    'name:p:2=nu': 0.55,
    'name:p:2=oa': -0.35,
    'name:p:2=ob': -0.51,
    'name:p:2=od': 0.45,
    'name:p:2=oe': -0.31,
    'name:p:2=og': 0.49,
    'name:p:2=ok': 0.48,
    'name:p:2=ol': -0.21,
    'name:p:2=om': 0.39,
    'name:p:2=on': -0.63,
    'name:p:2=oo': 0.9,
    'name:p:2=or': 1.54,
    'name:p:2=os': -0.56,
    'name:p:2=ot': -1.3,
    'name:p:2=ou': 1.5,
    'name:p:2=ow': -0.3,
    'name:p:2=ox': -0.54,
    'name:p:2=oz': 0.46,
    'name:p:2=pe': -0.11,
    'name:p:2=px': -0.4,
    'name:p:2=ra': 0.16,
    'name:p:2=rd': 0.86,
    'name:p:2=re': -0.7,
    'name:p:2=ri': 0.73,
    'name:p:2=rk': 1.18,
    'name:p:2=rl': 0.52,
    'name:p:2=rn': 0.45,
    'name:p:2=ro': 0.71,
    'name:p:2=rs': 0.85,
    'name:p:2=rt': -0.62,
    'name:p:2=ru': 0.24,
    'name:p:2=ry': -0.93,
    'name:p:2=rz': -0.33,
    'name:p:2=ré': -0.18,
    'name:p:2=ró': 1.16,
    'name:p:2=rö': -0.23,
    'name:p:2=rü': 0.17,
    'name:p:2=sa': -1.17,
    'name:p:2=se': -1.62,
    'name:p:2=sh': -0.6,
    'name:p:2=si': 0.42,
    'name:p:2=sk': 2.23,
    'name:p:2=so': -0.16,
    'name:p:2=ss': 1.46,
    'name:p:2=st': 1.2,
    'name:p:2=sy': -0.14,
    'name:p:2=só': 1.72,
    'name:p:2=ta': -1.76,
    'name:p:2=th': -0.41,
    'name:p:2=to': 0.66,
    'name:p:2=ts': 0.22,
    'name:p:2=tt': 0.41,
    'name:p:2=ty': -0.14,
    'name:p:2=tz': 0.76,
    'name:p:2=tó': 1.28,
    'name:p:2=u': -0.15,
    'name:p:2=ua': -0.7,
    'name:p:2=uc': -1.05,
    'name:p:2=ue': -0.32,
    'name:p:2=uf': 0.42,
    'name:p:2=ug': -0.73,
    'name:p:2=ul': 0.58,
    'name:p:2=um': -0.44,
    'name:p:2=ur': 0.16,
    'name:p:2=us': -0.19,
    'name:p:2=ut': -0.31,
    'name:p:2=uy': -0.22,
    'name:p:2=uz': -0.27,
    'name:p:2=va': -0.26,
    'name:p:2=ve': -0.16,
    'name:p:2=vx': -0.38,
    'name:p:2=wn': -0.31,
    'name:p:2=ya': -0.6,
    'name:p:2=ys': -0.26,
    'name:p:2=yó': 1.4,
    'name:p:2=z': -0.13,
    'name:p:2=ze': 0.18,
    'name:p:2=zo': 0.44,
    'name:p:2=zt': -1.37,
    'name:p:2=zó': 1.52,
    'name:p:2=ée': -0.17,
    'name:p:2=én': -0.21,
    'name:p:2=ês': -0.33,
    'name:p:2=ío': -0.35,
    'name:p:2=ür': -0.49,
    'name:p::': 1.65,
    'name:p:class=adv': -3.13,
    'name:p:class=conj': 0.55,
    'name:p:class=det': -3.85,
    'name:p:class=prep': 1.53,
    'name:p:class=pron': -3.33,
    'name:p:class=title': 3.07,
    'name:p:line': 0.47,
    "name:p:open'": 0.83,
    'name:p:open(': -0.12,
    'name:p:stop': -0.43,
    'name:p:stop=1': 0.51,
    'name:p:stop=10': 0.45,
    'name:p:stop=12': 0.49,
    'name:p:stop=17': -0.15,
    'name:p:stop=19': -0.16,
    'name:p:stop=2': -0.14,
    'name:p:stop=28': 0.22,
    'name:p:stop=32': 0.16,
    'name:p:stop=37': 0.21,
    'name:p:stop=4': 0.47,
    'name:p:stop=40': 0.33,
    'name:p:stop=43': -0.35,
    'name:p:stop=44': -0.44,
    'name:p:stop=47': 0.64,
    'name:p:stop=5': 0.18,
    'name:p:stop=53': -0.18,
    'name:p:stop=56': -0.16,
    'name:p:stop=60': 0.59,
    'name:p:stop=61': 0.56,
    'name:p:stop=62': -0.18,
    'name:p:stop=7': 0.4,
    'name:p:stop=70': 0.89,
    'name:p:stop=71': 0.25,
    'name:p:stop=74': 0.45,
    'name:p:stop=75': 0.26,
    'name:p:stop=87': 0.14,
    'name:p:stop=88': 0.25,
    'name:p:stop=92': 0.32,
    'name:p:stop=99': 0.5,
    'name:p:stop=Dr': 1.25,
    'name:p:stop=Dra': 1.09,
    'name:p:stop=M': 1.25,
    'name:p:stop=Mr': 0.44,
    'name:p:stop=Mrs': 0.41,
    'name:p:stop=Ms': 0.42,
    'name:p:stop=N': -0.47,
    'name:p:stop=Prof': 1.21,
    'name:p:stop=Sr': 0.74,
    'name:p:stop=Sra': 0.86,
    'name:p:stop=U': -0.15,
    'name:p:stop=Z': -0.13,
    'name:p:stop=ayer': -0.49,
    'name:p:stop=bajo': -0.46,
    'name:p:stop=city': 0.51,
    'name:p:stop=clé': -0.69,
    'name:p:stop=cold': -0.13,
    'name:p:stop=cut': -0.22,
    'name:p:stop=da': 0.51,
    'name:p:stop=days': -0.26,
    'name:p:stop=es': -0.12,
    'name:p:stop=gut': 0.11,
    'name:p:stop=it': 1.17,
    'name:p:stop=leer': -0.37,
    'name:p:stop=left': 0.22,
    'name:p:stop=là': -0.22,
    'name:p:stop=main': 0.22,
    'name:p:stop=neu': 0.55,
    'name:p:stop=not': 1.04,
    'name:p:stop=page': -0.86,
    'name:p:stop=red': -0.14,
    'name:p:stop=town': -0.24,
    'name:p:stop=um': -0.15,
    'name:p:stop=weit': -0.2,
    'name:p:stop=word': -0.14,
    'name:p:stop=zu': -0.56,
    'name:p:word': -0.26,
    'name:p=#': -1.58,
    'name:p=##': -0.91,
    'name:p=0': -0.48,
    'name:p=0.': 0.15,
    'name:p=00': -0.87,
    'name:p=00.': 0.79,
    'name:p=00.00.0000': -0.57,
    'name:p=00.00.0000.': 1.09,
    'name:p=00.00.0000:': -0.26,
    'name:p=000': -0.84,
    'name:p=000-000-000': -0.12,
    'name:p=000-000-0000.': -0.13,
    'name:p=0000-00-00': -1.17,
    'name:p=0000-00-0000000': -0.1,
    'name:p=0000.': -0.16,
    'name:p=000000.': 0.13,
    'name:p=00000000': -0.56,
    'name:p=00000000.': -0.41,
    'name:p=00000000:': -0.22,
    'name:p=00:00': -0.74,
    'name:p=00:00.': -0.12,
    'name:p=00:00:': -0.38,
    'name:p=00:00]': 1.52,
    'name:p=0:': -0.35,
    'name:p=0:00]': 0.82,
    'name:p=:': 1.88,
    'name:p=>': -0.82,
    'name:p=a': -1.5,
    'name:p=abrió': 0.64,
    'name:p=absender:': 0.97,
    'name:p=account': -0.94,
    'name:p=affaire.': -1.11,
    'name:p=again.': 0.56,
    'name:p=angabe': -1.11,
    'name:p=anna': -0.76,
    'name:p=answered': 0.62,
    'name:p=appendix': -0.99,
    'name:p=applicant:': 0.27,
    'name:p=arrived': 0.16,
    'name:p=ask': 1.07,
    'name:p=astrid': -0.35,
    'name:p=at': -0.34,
    'name:p=attendee:': 0.4,
    'name:p=aussi.': -0.29,
    'name:p=author:': 0.54,
    'name:p=autor:': 0.1,
    'name:p=avec': -1.14,
    'name:p=ayer.': -0.23,
    'name:p=bei': -0.89,
    'name:p=bin': -1.44,
    'name:p=bjarne': -0.5,
    'name:p=books.': 0.26,
    'name:p=brief': -1.46,
    'name:p=budget': 0.32,
    'name:p=buyer:': 0.41,
    'name:p=by': 2.06,
    'name:p=c/': -0.26,
    'name:p=calle': -0.21,
    'name:p=camille': -0.78,
    'name:p=candle.': 0.1,
    'name:p=caretaker:': 0.58,
    'name:p=cc': 0.93,
    'name:p=cerró': 0.92,
    'name:p=chapter': -1.25,
    'name:p=checked': 0.27,
    'name:p=chiara': -0.26,
    'name:p=chidi': -0.27,
    'name:p=city': 0.23,
    'name:p=city.': 0.73,
    'name:p=clerk:': 0.25,
    'name:p=closed': 0.53,
    'name:p=closed.': -0.17,
    'name:p=coach:': 0.92,
    'name:p=coffee': 0.1,
    'name:p=coffee.': 0.28,
    'name:p=commande': -0.21,
    'name:p=confirmed': 0.4,
    'name:p=contact:': 0.5,
    'name:p=contacto:': 0.79,
    'name:p=cours': -0.19,
    'name:p=cut.': -0.2,
    'name:p=da.': -0.3,
    'name:p=david': -0.54,
    'name:p=de': 0.39,
    'name:p=del': -0.85,
    'name:p=della': -1.12,
    'name:p=den': -0.27,
    'name:p=der': -1.25,
    'name:p=des': -0.18,
    'name:p=dossier.': -0.4,
    'name:p=dr': 1.35,
    'name:p=dr.': 1.17,
    'name:p=dra.': 0.77,
    'name:p=driver:': 0.6,
    'name:p=du': -1.25,
    'name:p=each': -1.87,
    'name:p=editor:': 0.32,
    'name:p=empfänger:': 0.27,
    'name:p=entregó': 0.47,
    'name:p=erik': -0.36,
    'name:p=escribió': 0.94,
    'name:p=evening.': -0.1,
    'name:p=explained': 0.53,
    'name:p=explicó': 0.98,
    'name:p=fahrer:': 1.01,
    'name:p=fehlt.': 0.49,
    'name:p=fenster': -0.67,
    'name:p=fermée.': -0.43,
    'name:p=final': -0.15,
    'name:p=firmó': 0.84,
    'name:p=follow.': -0.15,
    'name:p=for': 0.62,
    'name:p=frau': 0.98,
    'name:p=from': 2.11,
    'name:p=from:': 0.35,
    'name:p=gate': -0.44,
    'name:p=gave': 1.29,
    'name:p=george': -0.51,
    'name:p=gt': -0.19,
    'name:p=gut.': 0.45,
    'name:p=guten': -0.64,
    'name:p=hans': -0.32,
    'name:p=hans-peter': -0.46,
    'name:p=health': -0.21,
    'name:p=heinrich': -1.22,
    'name:p=herr': 0.86,
    'name:p=herrn': 1.35,
    'name:p=host:': 0.45,
    'name:p=in': -1.93,
    'name:p=ingrid': -0.19,
    'name:p=inquilino:': 0.34,
    'name:p=insisted': 0.92,
    'name:p=inês': -0.2,
    'name:p=is': 1.32,
    'name:p=ist': -0.14,
    'name:p=it.': 0.49,
    'name:p=jakob': -0.36,
    'name:p=james': -0.61,
    'name:p=jan': -0.37,
    'name:p=john': -0.29,
    'name:p=jürgen': -0.18,
    'name:p=karte:': -0.17,
    'name:p=kasse': -0.2,
    'name:p=katya': -0.6,
    'name:p=kg.': -0.27,
    'name:p=kontakt:': 0.82,
    'name:p=kwame': -0.51,
    'name:p=käthe': -0.67,
    'name:p=käufer:': 0.64,
    'name:p=la': -1.74,
    'name:p=laura': -0.22,
    'name:p=laut': 2.08,
    'name:p=le': -1.3,
    'name:p=leer.': -0.22,
    'name:p=left': 0.88,
    'name:p=left.': -0.13,
    'name:p=lehrerin:': 0.51,
    'name:p=leitung:': 0.42,
    'name:p=leyó': 1.07,
    'name:p=liebe': -0.9,
    'name:p=light': -0.29,
    'name:p=long': -0.46,
    'name:p=luc': -0.3,
    'name:p=lucía': -0.17,
    'name:p=lunch.': 0.13,
    'name:p=m.': 0.27,
    'name:p=mail': -0.13,
    'name:p=main.': 0.22,
    'name:p=manager:': 0.9,
    'name:p=martin': -0.47,
    'name:p=mentioned': 0.71,
    'name:p=mesure.': -0.35,
    'name:p=mit': 1.57,
    'name:p=mme': 0.69,
    'name:p=morning.': -0.11,
    'name:p=mot': -2.04,
    'name:p=mr': 0.26,
    'name:p=mr.': 0.36,
    'name:p=mrs.': 0.26,
    'name:p=ms.': 0.24,
    'name:p=n.': -0.47,
    'name:p=nach': -1.69,
    'name:p=near': -0.14,
    'name:p=neu.': 0.5,
    'name:p=niamh': -0.18,
    'name:p=nicht.': 0.28,
    'name:p=not': -0.67,
    'name:p=not.': 0.76,
    'name:p=note:': 0.8,
    'name:p=nous': -0.21,
    'name:p=of': 0.13,
    'name:p=olwen': -0.16,
    'name:p=opened': 0.98,
    'name:p=or': 0.39,
    'name:p=organizó': 0.73,
    'name:p=owner:': 0.87,
    'name:p=pagó': 1.03,
    'name:p=paid': 1.25,
    'name:p=par': 1.6,
    'name:p=percent.': -0.29,
    'name:p=peter': -1.26,
    'name:p=pidió': 0.51,
    'name:p=pierre': -0.71,
    'name:p=por': 1.19,
    'name:p=porte': -0.11,
    'name:p=porte.': -0.31,
    'name:p=porter:': 0.49,
    'name:p=presentó': 0.97,
    'name:p=prof.': 0.97,
    'name:p=profesora:': 0.11,
    'name:p=prüfer:': 0.41,
    'name:p=rajesh': -0.2,
    'name:p=reads': 1.68,
    'name:p=rechnung': -0.4,
    'name:p=recipient:': 1.19,
    'name:p=recorded': 0.56,
    'name:p=red': -1.11,
    'name:p=red.': -0.14,
    'name:p=repaired': 0.63,
    'name:p=reported': 0.52,
    'name:p=responsable:': 0.19,
    'name:p=reviewer:': 0.47,
    'name:p=revisó': 0.63,
    'name:p=rocío': -0.16,
    'name:p=rue': -0.25,
    'name:p=safety.': -0.2,
    'name:p=saw': -0.37,
    'name:p=schlüssel': -0.11,
    'name:p=school': -0.13,
    'name:p=see': -0.85,
    'name:p=según': 1.28,
    'name:p=selon': 1.61,
    'name:p=senden.': 0.47,
    'name:p=sender:': 0.62,
    'name:p=showed': 0.63,
    'name:p=simon': -0.21,
    'name:p=sitzt': -0.43,
    'name:p=sommes': -0.12,
    'name:p=sr.': 0.49,
    'name:p=sra.': 0.5,
    'name:p=station.': 0.56,
    'name:p=stopped': 0.33,
    'name:p=subject:': -1.83,
    'name:p=supervisor:': 0.21,
    'name:p=table': -0.26,
    'name:p=table.': 0.34,
    'name:p=también.': -0.15,
    'name:p=tarde.': -0.41,
    'name:p=teacher:': 0.45,
    'name:p=temperatur': -0.46,
    'name:p=tenant:': 0.3,
    'name:p=thanked': 1.01,
    'name:p=the': -1.52,
    'name:p=thomas': -0.72,
    'name:p=to': 1.27,
    'name:p=to:': 1.29,
    'name:p=today.': 0.73,
    'name:p=told': 0.82,
    'name:p=town.': -0.3,
    'name:p=tradujo': 1.06,
    'name:p=tried': 0.43,
    'name:p=two': -1.91,
    'name:p=u.': -0.14,
    'name:p=upper': -0.59,
    'name:p=van': -1.25,
    'name:p=verfasser:': 0.74,
    'name:p=vermieter:': 0.61,
    'name:p=vertretung:': 0.37,
    'name:p=visitors:': 0.52,
    'name:p=von': 0.44,
    'name:p=waited': 0.43,
    'name:p=war': -0.49,
    'name:p=warned': 0.67,
    'name:p=weit.': -0.41,
    'name:p=werkzeug': -0.75,
    'name:p=with': -0.83,
    'name:p=witness:': 0.27,
    'name:p=wurde': -2.62,
    'name:p=zahl': -0.41,
    'name:p=zeuge:': 0.59,
    'name:p=zu': -2.47,
    'name:p=élodie': -0.19,
    'name:particle': 0.53,
    'name:pp=00 00.': -0.58,
    'name:pp=00 aussi.': 0.55,
    'name:pp=00 clé.': -0.69,
    'name:pp=00 dossier.': -0.99,
    'name:pp=00 km': 0.22,
    'name:pp=00 m': -0.29,
    'name:pp=00 percent.': -0.3,
    'name:pp=00 today.': 0.59,
    'name:pp=00 war': -0.45,
    'name:pp=00. la': -0.6,
    'name:pp=00.00.0000 00:00': -0.47,
    'name:pp=000 n.': -0.22,
    'name:pp=0000 0000.': -0.34,
    'name:pp=0000-00-00 00:00': -0.24,
    'name:pp=0000-00-00 00:00.': -0.72,
    'name:pp=00000000 00:00': -0.94,
    'name:pp=00000000 00:00.': -0.22,
    'name:pp=00000000 00:00:': -0.24,
    'name:pp=00:00] theatre:': -0.29,
    'name:pp=according to': 1.44,
    'name:pp=account for': -0.47,
    'name:pp=adresse: 000': -0.17,
    'name:pp=after lunch.': 0.27,
    'name:pp=an 00': -0.11,
    'name:pp=an 000': -0.58,
    'name:pp=angabe von': 1.68,
    'name:pp=apporté par': 0.68,
    'name:pp=apt 0.': -0.1,
    'name:pp=are with': 1.37,
    'name:pp=at 0.': -0.27,
    'name:pp=at 00.': -0.68,
    'name:pp=at lab': -0.19,
    'name:pp=at mail': -0.13,
    'name:pp=at post': -0.13,
    'name:pp=auteur :': 0.37,
    'name:pp=avec dr': 0.53,
    'name:pp=avec m.': 0.96,
    'name:pp=avec mme': 0.56,
    'name:pp=bei frau': 1.15,
    'name:pp=bei herr': 0.31,
    'name:pp=bei herrn': 0.63,
    'name:pp=bestellt von': 0.35,
    'name:pp=bestellung 00000000': -0.2,
    'name:pp=bestätigt von': 0.79,
    'name:pp=bezahlt von': 1.09,
    'name:pp=bitte bei': -0.99,
    'name:pp=booked by': 0.32,
    'name:pp=booked for': 0.28,
    'name:pp=brief von': 1.26,
    'name:pp=budget for': 0.32,
    'name:pp=by dr': 0.15,
    'name:pp=by mr.': 0.33,
    'name:pp=by mrs.': 0.27,
    'name:pp=by ms.': 0.12,
    'name:pp=by prof.': 0.11,
    'name:pp=caja de': 0.2,
    'name:pp=calendar of': 0.3,
    'name:pp=calle de': -0.23,
    'name:pp=camino de': -0.69,
    'name:pp=candle 00:': 0.31,
    'name:pp=candle of': -0.12,
    'name:pp=card for': 0.3,
    'name:pp=card of': 0.56,
    'name:pp=carta de': 1.1,
    'name:pp=carte de': -1.06,
    'name:pp=chauffeur :': 0.24,
    'name:pp=city and': -0.3,
    'name:pp=city for': -0.37,
    'name:pp=city of': 0.23,
    'name:pp=cleaned by': 0.8,
    'name:pp=cleaned for': 0.2,
    'name:pp=clock of': 0.17,
    'name:pp=coffee for': 0.18,
    'name:pp=coffee of': 0.37,
    'name:pp=commandé par': 0.37,
    'name:pp=compté par': 0.32,
    'name:pp=con dra.': 0.8,
    'name:pp=con sr.': 0.43,
    'name:pp=con sra.': 0.36,
    'name:pp=confirmado por': 0.29,
    'name:pp=confirmé par': 0.38,
    'name:pp=contado por': 0.52,
    'name:pp=copies of': -0.8,
    'name:pp=corrected by': 0.45,
    'name:pp=course for': 1.13,
    'name:pp=course of': -0.36,
    'name:pp=cuenta de': 0.43,
    'name:pp=das zahl': -0.37,
    'name:pp=de la': -0.3,
    'name:pp=delivered by': 0.84,
    'name:pp=der brief': -1.23,
    'name:pp=der karte:': -0.17,
    'name:pp=destinataire :': 0.19,
    'name:pp=door and': -0.12,
    'name:pp=drafted by': 0.34,
    'name:pp=editor) and': 0.2,
    'name:pp=en 000': -0.25,
    'name:pp=entrega de': 0.53,
    'name:pp=entregado por': 0.34,
    'name:pp=es weit.': 0.25,
    'name:pp=es wurde': -2.39,
    'name:pp=escrito por': 0.56,
    'name:pp=est là.': -0.18,
    'name:pp=está en': -0.11,
    'name:pp=exam to': 0.38,
    'name:pp=examined by': 0.94,
    'name:pp=examined for': 0.74,
    'name:pp=factura de': -0.42,
    'name:pp=fell out.': -0.12,
    'name:pp=floor for': 0.14,
    'name:pp=floor of': 0.43,
    'name:pp=for by': 1.72,
    'name:pp=frau dr.': 0.19,
    'name:pp=garden for': -0.77,
    'name:pp=gebracht von': 1.23,
    'name:pp=go to': -0.34,
    'name:pp=graded by': 1.12,
    'name:pp=haben mit': 1.3,
    'name:pp=health and': -0.62,
    'name:pp=health of': -0.49,
    'name:pp=host) and': 0.13,
    'name:pp=house for': -0.32,
    'name:pp=house of': -0.31,
    'name:pp=i arrived': 0.52,
    'name:pp=i insisted': 0.21,
    'name:pp=i mentioned': 0.71,
    'name:pp=i opened': 0.78,
    'name:pp=i paid': 0.51,
    'name:pp=i showed': 1.2,
    'name:pp=i thanked': 0.77,
    'name:pp=i warned': 0.65,
    'name:pp=inspected by': 0.23,
    'name:pp=is chapter': -1.21,
    'name:pp=is for': 1.62,
    'name:pp=is northern.': -0.19,
    'name:pp=is not': -0.66,
    'name:pp=issued by': 1.11,
    'name:pp=ist 00': -0.12,
    'name:pp=ist 000': -0.18,
    'name:pp=ist neu.': 0.65,
    'name:pp=ist zu.': -0.18,
    'name:pp=kitchen and': -0.6,
    'name:pp=kitchen for': 0.29,
    'name:pp=kitchen of': 1.04,
    'name:pp=la cours': -0.11,
    'name:pp=la rue': -0.23,
    'name:pp=la table': -0.26,
    'name:pp=la tarde.': 0.43,
    'name:pp=label reads': 0.59,
    'name:pp=le mot': -1.58,
    'name:pp=lecteur :': 0.42,
    'name:pp=led by': 0.85,
    'name:pp=lent the': -1.64,
    'name:pp=letter for': -1.13,
    'name:pp=letter of': 0.51,
    'name:pp=letter to': 0.17,
    'name:pp=light for': 0.97,
    'name:pp=light of': -0.35,
    'name:pp=livré par': 0.59,
    'name:pp=llave de': 1.14,
    'name:pp=lo abrió': 0.83,
    'name:pp=lo cerró': 0.74,
    'name:pp=lo entregó': 1.16,
    'name:pp=lo escribió': 0.74,
    'name:pp=lo explicó': 0.63,
    'name:pp=lo firmó': 0.95,
    'name:pp=lo leyó': 0.69,
    'name:pp=lo organizó': 0.95,
    'name:pp=lo pagó': 0.87,
    'name:pp=lo pidió': 0.63,
    'name:pp=lo presentó': 0.77,
    'name:pp=lo revisó': 0.69,
    'name:pp=lo tradujo': 0.83,
    'name:pp=locataire :': 0.18,
    'name:pp=lámpara de': 1.94,
    'name:pp=measured by': 0.75,
    'name:pp=memory of': 0.57,
    'name:pp=mot de': 2.36,
    'name:pp=moved to': -0.15,
    'name:pp=mudamos a': -0.19,
    'name:pp=nach angabe': -1.07,
    'name:pp=night of': 0.36,
    'name:pp=nobody confirmed': 0.13,
    'name:pp=nobody gave': 0.49,
    'name:pp=nobody paid': 0.33,
    'name:pp=nobody thanked': 0.39,
    'name:pp=notiz 00:': -0.95,
    'name:pp=nurse) and': 0.16,
    'name:pp=okonkwo and': 0.23,
    'name:pp=open at': -0.66,
    'name:pp=opened by': 0.87,
    'name:pp=opens with': -2.01,
    'name:pp=organised by': 0.82,
    'name:pp=our office:': -0.25,
    'name:pp=owner) and': 0.13,
    'name:pp=pagado por': 0.88,
    'name:pp=painted by': 0.58,
    'name:pp=paper of': 0.22,
    'name:pp=payé par': 0.58,
    'name:pp=pedido de': 0.79,
    'name:pp=picture for': -0.8,
    'name:pp=picture of': 0.55,
    'name:pp=place de': -0.26,
    'name:pp=played by': 0.97,
    'name:pp=preparado por': 0.38,
    'name:pp=price of': 0.92,
    'name:pp=price to': 0.67,
    'name:pp=printed by': 0.44,
    'name:pp=professeur :': 0.51,
    'name:pp=project of': 0.25,
    'name:pp=project" reads': 0.17,
    'name:pp=préparé par': 0.2,
    'name:pp=puerta de': 1.11,
    'name:pp=página de': -0.84,
    'name:pp=received by': 0.37,
    'name:pp=registered by': 0.16,
    'name:pp=relu par': 0.46,
    'name:pp=repariert von': 0.91,
    'name:pp=report of': 0.51,
    'name:pp=reported by': 0.83,
    'name:pp=responsable :': 0.1,
    'name:pp=returned by': 0.33,
    'name:pp=returned for': 0.89,
    'name:pp=reunión de': 1.15,
    'name:pp=review of': -1.8,
    'name:pp=revisada por': 0.54,
    'name:pp=rue des': -0.14,
    'name:pp=run by': 0.74,
    'name:pp=rédigée par': 0.13,
    'name:pp=safety for': 0.36,
    'name:pp=safety of': -0.18,
    'name:pp=sala de': 0.71,
    'name:pp=school of': 0.72,
    'name:pp=screen of': -0.92,
    'name:pp=see appendix': -1.0,
    'name:pp=seen near': -0.14,
    'name:pp=seite 00:': -1.19,
    'name:pp=seite 0:': -0.48,
    'name:pp=semana de': 0.56,
    'name:pp=signal and': -0.53,
    'name:pp=signal for': -0.28,
    'name:pp=signal of': 1.0,
    'name:pp=sind da.': -0.3,
    'name:pp=sitzt dr.': 0.22,
    'name:pp=sitzt frau': 0.27,
    'name:pp=sitzt herr': 0.41,
    'name:pp=sitzt herrn': 1.08,
    'name:pp=sommes 000': -0.15,
    'name:pp=sorted by': 0.8,
    'name:pp=speech for': -0.38,
    'name:pp=speech of': 0.18,
    'name:pp=stands at': -0.79,
    'name:pp=station of': 0.52,
    'name:pp=station to': 0.43,
    'name:pp=stress for': 0.44,
    'name:pp=stress of': 0.44,
    'name:pp=stress to': 0.17,
    'name:pp=suite 0.': 0.51,
    'name:pp=table for': -1.06,
    'name:pp=table of': -0.17,
    'name:pp=taken by': 0.56,
    'name:pp=tanaka and': 0.33,
    'name:pp=tested by': 0.51,
    'name:pp=tested for': 0.13,
    'name:pp=the city.': 0.52,
    'name:pp=theatre for': 0.7,
    'name:pp=theatre of': 0.26,
    'name:pp=they arrived': 0.14,
    'name:pp=they gave': 0.23,
    'name:pp=they paid': 0.42,
    'name:pp=they warned': 0.18,
    'name:pp=tisch sitzt': -0.35,
    'name:pp=to 000': -0.15,
    'name:pp=town or': -0.65,
    'name:pp=traducido por': 0.36,
    'name:pp=traduit par': 0.2,
    'name:pp=traído por': 0.39,
    'name:pp=treffpunkt ist': -0.21,
    'name:pp=two books.': -0.28,
    'name:pp=two is': 1.64,
    'name:pp=typed by': 0.77,
    'name:pp=témoin :': 0.35,
    'name:pp=um 00:00': -0.19,
    'name:pp=unterrichtet von': 1.03,
    'name:pp=use the': -0.66,
    'name:pp=valley and': -0.32,
    'name:pp=valley of': 0.7,
    'name:pp=van den': -0.36,
    'name:pp=van der': -0.58,
    'name:pp=ventana de': 1.48,
    'name:pp=verified by': 0.53,
    'name:pp=voice for': 0.13,
    'name:pp=voice of': -0.5,
    'name:pp=vorbereitet von': 1.21,
    'name:pp=waren leer.': -0.16,
    'name:pp=was closed.': -0.74,
    'name:pp=was cut.': -0.22,
    'name:pp=we saw': -0.72,
    'name:pp=weather and': -0.11,
    'name:pp=weather for': 0.11,
    'name:pp=weather of': 0.7,
    'name:pp=went from': 1.02,
    'name:pp=went with': 1.03,
    'name:pp=word of': 0.41,
    'name:pp=wurde von': 2.09,
    'name:pp=zieht nach': -0.2,
    'name:pp=écrit par': 0.48,
    'name:pp=était fermée.': -0.29,
    'name:pp=übersetzt von': 1.11,
    'name>address:\n': 1.62,
    'name>address:\nAlte': -0.12,
    'name>address:\nNeue': -0.37,
    'name>address:\nZum': -0.6,
    'name>address:(': -1.62,
    'name>address:,': 1.4,
    'name>address:.': -0.3,
    'name>address::': -0.58,
    'name>address:ist': -0.41,
    'name>address:lines': -0.84,
    'name>email:\ncc:': 0.38,
    'name>email:,': 1.37,
    'name>email:.': 0.48,
    'name>email:.\ncc:': 0.39,
    'name>email:. cc:': -0.16,
    'name>email:<': 1.08,
    'name>email:_': 0.46,
    'name>email:cc:': 0.71,
    'name>email:lines': 0.16,
    'name>email:near': 0.93,
    'name>identity:,': -0.33,
    'name>identity:, DNI': 1.1,
    'name>identity:, MRN': 0.31,
    'name>identity:, NIE': 0.8,
    'name>identity:, SSN': 0.74,
    'name>identity:.': -2.2,
    'name>identity:_': -2.31,
    'name>identity:lines': -0.37,
    'name>identity:near': 1.33,
    'name>identity:no.': -0.18,
    'name>name:\n': -0.89,
    'name>name:\n\n': 0.25,
    'name>name:\n -- \n': 0.76,
    'name>name:\n Der': -0.5,
    'name>name:\n Two': -0.44,
    'name>name:\n-- \n': 0.19,
    'name>name:,': -0.3,
    'name>name:,\n': -0.95,
    'name>name:,\n\n': -1.04,
    'name>name:-- \n': 0.2,
    'name>name:.': -0.65,
    'name>name:.\n': -0.43,
    'name>name:.\n-- \n': -0.21,
    'name>name:.\n1.': -0.78,
    'name>name:.\nIn': -0.64,
    'name>name:.\nLa': -0.29,
    'name>name:.\nMme': 1.01,
    'name>name:.\ncc': 0.31,
    'name>name:. #': -0.66,
    'name>name:. -- \n': 0.3,
    'name>name:. 30.': 0.12,
    'name>name:. Ask': 0.48,
    'name>name:. Dr': -0.43,
    'name>name:14.': 0.54,
    'name>name::': -0.5,
    'name>name:In': -0.52,
    'name>name:Nach': -0.72,
    'name>name:The': -0.21,
    'name>name:To:': 0.19,
    'name>name:_': -0.3,
    'name>name:and': 2.52,
    'name>name:le': -0.31,
    'name>name:lines': -0.17,
    'name>name:near': 0.16,
    'name>name:nous': -0.35,
    'name>name:or': 2.6,
    'name>name:to': 1.65,
    'name>name:von': -0.41,
    'name>phone:\n tel:': -0.57,
    'name>phone:\nTel.': 0.5,
    'name>phone:\ncall': 0.64,
    'name>phone:\nfax': 0.7,
    'name>phone:\ntel.': 0.39,
    'name>phone:\ntel:': 0.82,
    'name>phone:\ntél.': 0.93,
    'name>phone:,': 2.14,
    'name>phone:.': 0.45,
    'name>phone:.\n': -0.44,
    'name>phone:.\ntel:': 0.88,
    'name>phone:. tel:': 0.43,
    'name>phone:_': 0.76,
    'name>phone:au': -0.18,
    'name>phone:el': -0.28,
    'name>phone:gibt': -0.25,
    'name>phone:lines': 0.51,
    'name>phone:near': 0.26,
    'phone:area': 2.44,
    'phone:cut': -1.92,
    'phone:ext': 2.88,
    'phone:international': 1.95,
    'phone:label': -1.91,
    'phone:line': 0.49,
    'phone:line:': 0.42,
    'phone:line:.': 0.19,
    'phone:line:other': 0.42,
    'phone:n:)': -0.31,
    'phone:n:,': 2.96,
    'phone:n:-': 0.48,
    'phone:n:2=al': 0.55,
    'phone:n:2=cc': 1.19,
    'phone:n:2=ch': -0.68,
    'phone:n:2=ck': -0.77,
    'phone:n:2=ed': -1.6,
    'phone:n:2=el': -1.03,
    'phone:n:2=er': 0.31,
    'phone:n:2=es': -0.82,
    'phone:n:2=ft': -0.45,
    'phone:n:2=gs': -1.41,
    'phone:n:2=ht': -0.57,
    'phone:n:2=id': -0.78,
    'phone:n:2=il': 0.24,
    'phone:n:2=is': 0.46,
    'phone:n:2=ld': -0.21,
    'phone:n:2=lo': -0.73,
    'phone:n:2=lt': -1.65,
    'phone:n:2=nd': 0.51,
    'phone:n:2=ng': 0.27,
    'phone:n:2=re': -1.51,
    'phone:n:2=rk': -0.89,
    'phone:n:2=rn': -1.13,
    'phone:n:2=rs': -0.59,
    'phone:n:2=rt': -0.75,
    'phone:n:2=st': -1.4,
    'phone:n:2=te': 0.23,
    'phone:n:2=ts': -0.76,
    'phone:n:2=ve': -0.93,
    'phone:n:2=ws': -0.6,
    'phone:n:2=xt': 1.83,
    'phone:n:[': 0.53,
    'phone:n:cap': 1.68,
    'phone:n:class=adv': 1.11,
    'phone:n:class=conj': -0.35,
    'phone:n:class=prep': 2.33,
    'phone:n:class=pron': -0.79,
    'phone:n:digit': -1.88,
    'phone:n:line': 2.68,
    'phone:n:spaced': 0.88,
    'phone:n:word': -1.39,
    'phone:n=00': -0.59,
    'phone:n=000': -1.67,
    'phone:n=0000': -0.82,
    'phone:n=a': 1.16,
    'phone:n=after': 0.99,
    'phone:n=and': -1.97,
    'phone:n=are': -0.97,
    'phone:n=belongs': -0.97,
    'phone:n=brought': -0.53,
    'phone:n=cc': 1.18,
    'phone:n=closed': -0.24,
    'phone:n=der': 0.3,
    'phone:n=en': -0.78,
    'phone:n=es': -0.86,
    'phone:n=est': -0.73,
    'phone:n=ext': 1.47,
    'phone:n=fehlt': -0.95,
    'phone:n=for': 0.92,
    'phone:n=im': -0.62,
    'phone:n=in': 1.23,
    'phone:n=ist': -0.91,
    'phone:n=la': 0.41,
    'phone:n=o': 0.88,
    'phone:n=oder': 1.92,
    'phone:n=or': 2.13,
    'phone:n=ou': 1.07,
    'phone:n=por': 2.32,
    'phone:n=promised': -0.33,
    'phone:n=rows': -0.48,
    'phone:n=sur': -0.49,
    'phone:n=the': -0.96,
    'phone:n=they': 0.72,
    'phone:n=units': -0.42,
    'phone:n=visitors': -0.42,
    'phone:n=we': 0.62,
    'phone:n=x0': 1.05,
    'phone:n=x00': 1.33,
    'phone:nanp': 2.27,
    'phone:no_label': 0.22,
    'phone:other_shape': -1.17,
    'phone:p:,': 3.02,
    'phone:p:.': 3.14,
    'phone:p:2=ad': -0.43,
    'phone:p:2=ag': -1.13,
    'phone:p:2=al': -0.12,
    'phone:p:2=an': -0.78,
    'phone:p:2=au': 3.13,
    'phone:p:2=ax': 2.73,
    'phone:p:2=b': 0.13,
    'phone:p:2=bt': 2.45,
    'phone:p:2=ca': -0.23,
    'phone:p:2=ce': -2.45,
    'phone:p:2=ch': -2.15,
    'phone:p:2=ck': -1.12,
    'phone:p:2=ct': -1.23,
    'phone:p:2=cu': 0.12,
    'phone:p:2=de': -0.99,
    'phone:p:2=ed': -0.65,
    'phone:p:2=ei': -0.76,
    'phone:p:2=el': -0.35,
    'phone:p:2=em': -2.23,
    'phone:p:2=en': -1.01,
    'phone:p:2=er': -1.24,
    'phone:p:2=et': -2.08,
    'phone:p:2=ey': -1.76,
    'phone:p:2=ez': 0.42,
    'phone:p:2=fr': 0.57,
    'phone:p:2=ge': -1.07,
    'phone:p:2=hl': -1.4,
    'phone:p:2=ht': -1.34,
    'phone:p:2=hy': 0.37,
    'phone:p:2=ia': 0.11,
    'phone:p:2=id': 0.23,
    'phone:p:2=ie': -0.21,
    'phone:p:2=in': 0.88,
    'phone:p:2=ky': 1.09,
    'phone:p:2=ld': -1.88,
    'phone:p:2=le': -0.9,
    'phone:p:2=li': 0.45,
    'phone:p:2=ll': 2.12,
    'phone:p:2=lo': 0.2,
    'phone:p:2=me': 0.46,
    'phone:p:2=na': -2.12,
    'phone:p:2=ne': 2.34,
    'phone:p:2=ng': -1.24,
    'phone:p:2=ni': 0.35,
    'phone:p:2=nk': 0.53,
    'phone:p:2=nn': 0.97,
    'phone:p:2=no': 2.54,
    'phone:p:2=nr': -0.6,
    'phone:p:2=nt': -1.2,
    'phone:p:2=od': 0.37,
    'phone:p:2=on': 0.26,
    'phone:p:2=or': -1.77,
    'phone:p:2=ot': 0.21,
    'phone:p:2=ow': -2.14,
    'phone:p:2=ox': 0.18,
    'phone:p:2=pt': -2.03,
    'phone:p:2=rd': -0.99,
    'phone:p:2=re': -1.18,
    'phone:p:2=rk': 0.16,
    'phone:p:2=rn': 0.33,
    'phone:p:2=ro': -0.87,
    'phone:p:2=rt': -0.56,
    'phone:p:2=se': -1.98,
    'phone:p:2=sn': -0.23,
    'phone:p:2=ss': -1.97,
    'phone:p:2=st': 1.24,
    'phone:p:2=te': -0.12,
    'phone:p:2=tt': -1.1,
    'phone:p:2=ty': 0.21,
    'phone:p:2=ue': 0.11,
    'phone:p:2=ur': -0.19,
    'phone:p:2=ve': 0.13,
    'phone:p:2=wn': -1.05,
    'phone:p:2=él': 0.97,
    'phone:p::': 3.01,
    'phone:p:class=adv': -0.46,
    'phone:p:class=det': 2.86,
    'phone:p:class=prep': 2.89,
    'phone:p:line': 3.54,
    'phone:p:sign': 1.2,
    'phone:p:stop': 1.19,
    'phone:p:stop=Tel': 2.01,
    'phone:p:stop=no': -0.56,
    'phone:p:stop=tel': 1.67,
    'phone:p:stop=tél': 0.97,
    'phone:p:word': -0.88,
    'phone:p=0,': 0.37,
    'phone:p=00.': 0.37,
    'phone:p=al': 1.83,
    'phone:p=and': -1.8,
    'phone:p=are': -0.48,
    'phone:p=article': -1.75,
    'phone:p=artikel': -1.11,
    'phone:p=au': 1.17,
    'phone:p=ausweis-nr.': -0.13,
    'phone:p=ausweisnr.': -0.51,
    'phone:p=batch': -0.99,
    'phone:p=bestellung': -0.97,
    'phone:p=between': -1.26,
    'phone:p=build': -0.82,
    'phone:p=call': 1.15,
    'phone:p=card': -0.22,
    'phone:p=case': -1.01,
    'phone:p=clínica': -0.17,
    'phone:p=code': -1.53,
    'phone:p=counted': -0.41,
    "phone:p=d'identité": -0.5,
    'phone:p=el': 0.91,
    'phone:p=fax': 1.12,
    'phone:p=file': -1.2,
    'phone:p=gebäude': -0.99,
    'phone:p=gibt': 1.03,
    'phone:p=house': -0.61,
    'phone:p=id:': -0.29,
    'phone:p=identidad': -0.14,
    'phone:p=invoice': -0.87,
    'phone:p=item': -1.17,
    'phone:p=key': -1.01,
    'phone:p=le': 1.65,
    'phone:p=mobile': 2.19,
    'phone:p=model': -1.51,
    'phone:p=murphy,': 0.36,
    'phone:p=máquina': -1.02,
    'phone:p=net,': 0.72,
    'phone:p=no': -0.18,
    'phone:p=no.': -0.27,
    'phone:p=number': -1.96,
    'phone:p=nummer': -0.53,
    'phone:p=numéro': -0.91,
    'phone:p=on': 1.2,
    'phone:p=or': 0.16,
    'phone:p=order': -1.74,
    'phone:p=parcel': -1.86,
    'phone:p=passport': -0.11,
    'phone:p=patienten-nr.': -0.84,
    'phone:p=personalausweis': -0.17,
    'phone:p=phone': 1.47,
    'phone:p=phone:': 0.46,
    'phone:p=receipt': -0.97,
    'phone:p=record': -1.22,
    'phone:p=reference': -1.03,
    'phone:p=row': -1.13,
    'phone:p=sample': -1.75,
    'phone:p=serial': -1.49,
    'phone:p=steuer-id': -0.4,
    'phone:p=tel.': 0.59,
    'phone:p=tel:': 1.48,
    'phone:p=telefon': 1.8,
    'phone:p=teléfono': 1.69,
    'phone:p=than': -0.38,
    'phone:p=ticket': -1.06,
    'phone:p=tél.': 0.44,
    'phone:p=under': 1.74,
    'phone:p=unter': 0.77,
    'phone:p=versichertennummer': -0.16,
    'phone:p=version': -1.54,
    'phone:pairs': 2.15,
    'phone:plain_digits': -3.38,
    'phone:pp=000000 and': -1.07,
    'phone:pp=0000000 and': -1.07,
    'phone:pp=00000000 and': -1.1,
    'phone:pp=00000000000 and': -1.33,
    'phone:pp=and batch': -0.42,
    'phone:pp=and model': -0.38,
    'phone:pp=and receipt': -0.22,
    'phone:pp=and record': -0.23,
    'phone:pp=and reference': -0.1,
    'phone:pp=and serial': -0.53,
    'phone:pp=ask under': 1.7,
    'phone:pp=auskunft gibt': 0.65,
    'phone:pp=booked, call': 1.03,
    'phone:pp=booked, fax': 0.95,
    'phone:pp=booked, mobile': 2.1,
    'phone:pp=booked, phone': 1.12,
    'phone:pp=booked, tel.': 0.84,
    'phone:pp=booked, tel:': 0.33,
    'phone:pp=booked, telefon': 1.65,
    'phone:pp=booked, teléfono': 1.41,
    'phone:pp=cable number': -0.28,
    'phone:pp=carries build': -0.59,
    'phone:pp=carries model': -1.14,
    'phone:pp=carries number': -0.38,
    'phone:pp=carries sample': -1.17,
    'phone:pp=carries version': -1.37,
    'phone:pp=de identidad': -0.1,
    'phone:pp=der nummer': -0.45,
    'phone:pp=die bestellung': -0.86,
    'phone:pp=en el': 0.93,
    'phone:pp=erreichbar unter': 0.45,
    'phone:pp=est au': 0.94,
    'phone:pp=faites le': 1.07,
    'phone:pp=floor number': -0.3,
    'phone:pp=has ausweis-nr.': -0.11,
    'phone:pp=has call': 0.4,
    'phone:pp=has fax': 0.79,
    'phone:pp=has mobile': 1.16,
    'phone:pp=has phone': 0.32,
    'phone:pp=has tel.': 0.26,
    'phone:pp=has tel:': 0.11,
    'phone:pp=has telefon': 1.17,
    'phone:pp=has teléfono': 0.41,
    'phone:pp=id no.': -0.14,
    'phone:pp=insurance no.': -0.15,
    'phone:pp=insurance number': -0.29,
    'phone:pp=is on': 1.13,
    'phone:pp=joignable au': 1.05,
    'phone:pp=la máquina': -1.4,
    'phone:pp=llamarnos al': 2.33,
    'phone:pp=machine numéro': -1.03,
    'phone:pp=marque el': 1.07,
    'phone:pp=melden, tel.': 0.51,
    'phone:pp=more than': -0.49,
    'phone:pp=national id:': -0.39,
    "phone:pp=numéro d'identité": -0.26,
    'phone:pp=of build': -0.68,
    'phone:pp=of key': -0.42,
    'phone:pp=of order': -0.22,
    'phone:pp=paper number': -0.45,
    'phone:pp=part number': -1.19,
    'phone:pp=patient number': -0.81,
    'phone:pp=please call': 1.23,
    'phone:pp=serial number': -0.7,
    'phone:pp=sécurité sociale': -0.24,
    'phone:pp=there are': -0.44,
    'phone:pp=we counted': -0.55,
    'phone:unusual': -1.61,
    'phone:usual': 0.28,
    'phone:whole': 0.35,
    'phone>address:\n': 0.22,
    'phone>address:.': 1.01,
    'phone>address:.\n': -0.23,
    'phone>address:58.': -0.11,
    'phone>address:_': -0.21,
    'phone>email:\n': 0.3,
    'phone>email:\n\n': 0.15,
    'phone>email:.\n': 0.28,
    'phone>email:Mail': 0.36,
    'phone>email:cc:': 0.75,
    'phone>email:lines': 0.56,
    'phone>email:near': 0.38,
    'phone>email:o en': 1.54,
    'phone>email:oder': 1.64,
    'phone>email:or': 3.99,
    'phone>email:ou à': 1.61,
    'phone>identity:Word': -0.37,
    'phone>identity:near': -0.15,
    'phone>name:\n': -0.33,
    'phone>name:\n\n': -0.36,
    'phone>name:\n #': -0.4,
    'phone>name:\n 7.': 0.38,
    'phone>name:\nA': -0.45,
    'phone>name:\nDer': -0.66,
    'phone>name:\nHerr': 0.47,
    'phone>name:\nLa': -0.2,
    'phone>name:\nLaut': 0.71,
    'phone>name:\nTo:': 0.32,
    'phone>name:\nTwo': -0.34,
    'phone>name:\ncc': 0.12,
    'phone>name:##': -0.16,
    'phone>name:-- \n': 0.76,
    'phone>name:.': 0.15,
    'phone>name:.\n': -0.33,
    'phone>name:.\nAsk': -0.2,
    'phone>name:.\ncc': 0.18,
    'phone>name:. -- \n': 0.8,
    'phone>name:. 32.': 0.23,
    'phone>name:. 50.': -0.52,
    'phone>name:. 8.': -0.8,
    'phone>name:. A': -0.43,
    'phone>name:. Der': -0.27,
    'phone>name:. Dr': 0.92,
    'phone>name:. Dr.': 0.83,
    'phone>name:. In': -0.98,
    'phone>name:. La': -0.7,
    'phone>name:. Mme': 0.55,
    'phone>name:. The': -0.29,
    'phone>name:. Two': -0.43,
    'phone>name:. cc': 0.28,
    'phone>name:61.': 0.56,
    'phone>name:706.': -0.6,
    'phone>name:8925\n': -0.21,
    'phone>name:A': -0.34,
    'phone>name:Ask': 0.29,
    'phone>name:Each': -0.24,
    'phone>name:La': -0.27,
    'phone>name:Laut': 0.12,
    'phone>name:Two': -0.43,
    'phone>name:Von': -0.68,
    'phone>name:_': -0.37,
    'phone>name:cc': 0.82,
    'phone>name:lines': 0.4,
    'phone>name:near': 0.37,
    'phone>phone:\n tel:': 0.11,
    'phone>phone:. row': -0.37,
    'phone>phone:84.': -0.19,
    'phone>phone:_': 0.91,
    'phone>phone:and': -0.21,
    'phone>phone:lines': 0.22,
    'phone>phone:near': 0.31,
}
